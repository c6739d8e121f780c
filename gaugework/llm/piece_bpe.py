"""SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton finds the longest piece at each position. Pieces are laid from the left; a piece may follow another only if
the two, merged again from characters, come out as the same two. Where no piece fits, the last is taken back and its end
marked in a bit field, so that no position fails twice. Pieces joined so are exactly what merging by score gives.
Texts are cut before each space run, which no piece crosses; each distinct chunk is encoded once for a worker's memo (bounded).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import split_batches

SPACE = "▁"
MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 1_000_000
_NONE = hashlib.sha256(b"").hexdigest()
_LOADED: dict[str, PieceBpe] = {}


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_values = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.cut = re.compile(f"(?<!{SPACE})(?={SPACE})") if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else None
        #: Pieces that merging can yield at all.
        self.reached = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.reached:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.pair_count = 0
        self.prefixes: dict[str, str | None] = {}
        self.forms: dict[str, tuple[int, str, bytes]] = {}
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: always the adjacent pair whose union has the best score, the leftmost of equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            union = parts[left] + parts[right]
            if union in self.scores:
                heapq.heappush(queue, (-self.scores[union], left, right, union))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, left, right, union = heapq.heappop(queue)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != union:
                continue
            parts[left], parts[right] = union, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
                offer(left, after[right])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters again gives the two pieces."""
        if self.pair_count > PAIR_ENTRIES:
            self.pairs.clear()
            self.pair_count = 0
        self.pair_count += 1
        known = self.merged(left + right) == [left, right]
        self.pairs.setdefault(left, {})[right] = known
        return known

    def shorter(self, piece: str) -> str | None:
        """The longest reached piece that is a proper prefix; a first character that no piece covers counts as one."""
        if piece not in self.prefixes:
            found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.reached), None)
            self.prefixes[piece] = found or (piece[:1] if len(piece) > 1 else None)
        return self.prefixes[piece]

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk; a character that no piece covers stands as itself."""
        # matches come in order of their ends, so the longest from a start is the last
        longest = {end - reach: piece for end, (reach, piece) in self.automaton.iter(chunk)}
        pairs, fits = self.pairs, self.fits
        laid: list[str] = []
        at, failed, size, last, after = 0, 0, len(chunk), None, {}
        piece: str | None
        while at < size:
            piece = longest.get(at) or chunk[at]
            while True:
                while piece is not None:
                    if not failed or not failed >> (at + len(piece)) & 1:
                        good = last is None or after.get(piece)
                        if good or good is None and fits(last, piece):
                            break
                    piece = self.shorter(piece)
                if piece is not None:
                    break
                if last is None:
                    raise ValueError("no sequence of pieces covers the chunk")
                failed |= 1 << at
                piece = laid.pop()
                at -= len(piece)
                last = laid[-1] if laid else None
                after = pairs.get(last) or {}
                piece = self.shorter(piece)
            laid.append(piece)
            at += len(piece)
            last, after = piece, pairs.get(piece) or {}
        return laid

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8")] if self.byte_ids else [self.unknown]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without begin or end ids; none for an empty or null text."""
        return [i for chunk in self.chunks(text) for i in self.ids_of(self.split(chunk))]

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return self.cut.split(whole)[1:] if self.cut else [whole]  # the first cut is before the first character

    def raw_bytes(self, ids: list[int]) -> bytes:
        """Bytes of ids, spaces included, the one before the text not yet taken off."""
        out = bytearray()
        for i in ids:
            if i in self.byte_values:
                out.append(self.byte_values[i])
            elif i == self.unknown:
                out += " ⁇ ".encode()
            elif i not in self.silent:
                out += self.pieces[i].replace(SPACE, " ").encode()
        return bytes(out)

    def decode(self, ids: list[int]) -> str:
        raw = self.raw_bytes(ids)
        first = next((i for i in ids if i not in self.silent), None)
        if first is not None and first not in self.byte_values and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")

    def form(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids of a piece, the ids in decimal, and the bytes that they decode to."""
        known = self.forms.get(piece)
        if known is None:
            ids = self.ids_of([piece])
            known = len(ids), ",".join(map(str, ids)), self.raw_bytes(ids)
            if piece in self.ids:
                self.forms[piece] = known
        return known

    def chunk_form(self, chunk: str) -> tuple[int, str, bytes]:
        n, ids, raw = zip(*map(self.form, self.split(chunk)))
        return sum(n), ",".join(ids), b"".join(raw)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the ids decoded."""
        if not text:
            return 0, _NONE, _NONE
        memo = self.memo
        if self.cut and "  " not in text and SPACE not in text and text[0] != " ":
            chunks, lead = text.split(" "), SPACE  # each word is a chunk with its space
        else:
            chunks, lead = self.chunks(text), ""
        if len(memo) > MEMO_ENTRIES:  # keep what was met early: the frequent chunks
            for k in list(memo)[MEMO_ENTRIES // 2 :]:
                del memo[k]
        for c in set(chunks).difference(memo) if lead else ():
            memo[c] = self.chunk_form(lead + c)
        n, ids, raw = zip(*[memo[c] for c in chunks] if lead else map(self.chunk_form, chunks))
        decoded = b"".join(raw)
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded[1:] if decoded[:1] == b" " else decoded).hexdigest()


def loaded(path: str) -> PieceBpe:
    """The Python worker's model of a file."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column of ids (array<int>). A null or empty text has none; other columns stay; ``out`` replaces a column of its name."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(texts):
        model = loaded(path)
        return texts.map(model.encode)

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the texts of id lists; null and empty lists give ''."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def texts(lists):
        model = loaded(path)
        return lists.map(lambda x: model.decode([int(i) for i in x]))

    return df.withColumn(out, texts(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text.

    A null text counts as empty and has no ids. Keys may be null or repeat: each row has its own result, equal texts equal ones. Texts of any
    length are encoded whole. Other columns are dropped; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in (s for b in batches for s in split_batches([b], text)):
            n, ids, decoded = zip(*(model.digest(x) for x in batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Exact tokenizer ids, at less cost than the tokenizers library takes for whole texts.

Three encoders give the ids that the library gives with add_special_tokens=False, special tokens' strings in a text included.
``ByteEncoder``: byte-level files go through tiktoken, which merges by the same ranks. ``WordEncoder``: a file whose words end in a
suffix; texts of Latin letters become one symbol string with marked word ends, by numpy over many texts at once, and tiktoken merges
that. ``LibraryEncoder``: every other file, and every text that the other two leave: with a special token's string, with a very long
run of white space, or of other scripts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Texts laid end to end for one call, in characters.
GROUP_CHARS = 1 << 20
#: tiktoken's pattern matcher fails on far longer white space; the library takes those texts.
LONG_SPACE = re.compile(r"\s{10000}")
#: The split patterns of the two kinds of files, fixed values.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LOADED: dict[str, LibraryEncoder] = {}


def shown_bytes() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary: printable ones by themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranked(model: dict) -> bool:
    """Whether a BPE file's token numbers follow the order of its merges, so that merging by number is merging by rank."""
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return False
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbers = [model["vocab"].get(a + b) for a, b in merges]
    return None not in numbers and numbers == sorted(set(numbers)) and (not numbers or numbers[0] >= 256)


class LibraryEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the tokenizers library."""

    def __init__(self, path: str, file: dict):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file.get("added_tokens", [])) or r"(?!)")
        # a character that every special token has, so that most texts need no search
        shared = set.intersection(*(set(t["content"]) for t in file["added_tokens"])) if file.get("added_tokens") else set()
        self.hint = min(shared, key=str.isalnum) if shared else ""

    def plain(self, text: str) -> bool:
        """Whether the faster path may take the text."""
        if self.hint in text and self.special.search(text):
            return False
        return len(text) < 10_000 or not LONG_SPACE.search(text)

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null texts count as empty."""
        return [self.slow(t) if t else b"" for t in texts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


class ByteEncoder(LibraryEncoder):
    """Byte-level BPE by tiktoken; the file's own vocabulary gives the ranks."""

    @staticmethod
    def takes(file: dict) -> bool:
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and file.get("normalizer") is None
        return bool(plain) and ranked(model) and not model.get("end_of_word_suffix")

    def __init__(self, path: str, file: dict):
        import tiktoken

        super().__init__(path, file)
        shown = shown_bytes()
        added = {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in added}
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        fast = self.encoding.encode_to_numpy
        return [(fast(t, disallowed_special=()).tobytes() if self.plain(t) else self.slow(t)) if t else b"" for t in texts]


class WordEncoder(LibraryEncoder):
    """BPE with marked word ends, for texts of characters up to U+00FF.

    A symbol is a byte of a word, and whether it is the word's last. Symbols become characters: a to z stand for themselves, as last
    ones for A to Z; digits and ASCII marks stand for themselves as last ones; the others have two-byte characters, which tiktoken joins
    before all else. Words (runs of letters, single digits, runs of marks, contractions) are found by numpy; white space is dropped.
    """

    SPACE, LETTER, NUMBER, OTHER = range(4)
    #: Closes a text: the symbol of byte 255 as a last one, which no UTF-8 text has.
    MARK = 0x2FF

    @staticmethod
    def takes(file: dict) -> bool:
        normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        last = steps[-1] or {}
        level = last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space")
        return file.get("normalizer") == normal and steps[:-1] == [split] and level and ranked(file["model"]) and bool(file["model"].get("end_of_word_suffix"))

    def __init__(self, path: str, file: dict):
        import regex
        import tiktoken

        super().__init__(path, file)
        inner = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz" else 0x100 + b for b in range(256)])
        last = np.array([b - 32 if chr(b).islower() and b < 128 else b if 0x21 <= b < 0x7F and not chr(b).isalpha() else 0x200 + b for b in range(256)])
        suffix, shown = file["model"]["end_of_word_suffix"], shown_bytes()
        added = {t["content"] for t in file.get("added_tokens", [])}
        symbols = [chr(c) for c in dict.fromkeys([*inner.tolist(), *last.tolist()])]
        ranks = {s.encode(): k for k, s in enumerate(symbols) if ord(s) >= 128}
        for b in range(256):
            ranks.setdefault(bytes([b]), len(symbols) + b)
        base = len(symbols) + 256
        number = np.zeros(base + len(file["model"]["vocab"]), dtype="<u4")
        for token, i in file["model"]["vocab"].items():
            if token in added:
                continue
            closed = token.endswith(suffix)
            raw = [shown[c] for c in (token[: -len(suffix)] if closed else token)]
            coded = "".join(chr(inner[b]) for b in raw[: len(raw) - closed]) + (chr(last[raw[-1]]) if closed else "")
            rank = ranks.setdefault(coded.encode(), base + i)
            number[rank] = i
        self.number = number
        closing = "".join(re.escape(chr(c)) for c in sorted(set(last.tolist())))
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{closing}]*[{closing}]", mergeable_ranks=ranks, special_tokens={})
        self.mark_id = int(number[ranks[chr(self.MARK).encode()]])
        kind, low = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
        for c in range(256):
            low[c] = ord(chr(c).lower())
            group = unicodedata.category(chr(c))[0]
            kind[c] = self.LETTER if group == "L" else self.NUMBER if group == "N" else self.SPACE if regex.match(r"\s", chr(c)) else self.OTHER
        self.kind = kind
        # codes by lower-cased character: its lead byte where it has two, and its last byte, inner and closing
        trail = [c if c < 128 else 0x80 | c & 0x3F for c in low.tolist()]
        self.lead = np.array([inner[0xC0 | c >> 6] if c >= 128 else 0 for c in low.tolist()], dtype="<u2")
        self.tail = np.stack([inner[trail], last[trail]]).astype("<u2")

    def coded(self, raw: np.ndarray, marks: np.ndarray) -> str:
        """The symbol string of texts in Latin-1, each closed by a line end at one of ``marks``."""
        kind = self.kind[raw]
        after = np.append(kind[1:], 0)
        closes = (kind == self.NUMBER) | ((kind != self.SPACE) & (kind != after))
        for at in np.flatnonzero((raw == 0x27) & (after == self.LETTER)).tolist():
            if at and kind[at - 1] == self.OTHER:
                continue
            ahead = raw[at + 1 : at + 3].tobytes().decode("latin-1").lower()
            found = next((c for c in CONTRACTIONS if ahead.startswith(c)), None)
            if found:
                closes[at], closes[at + len(found)] = False, True
        kept = kind != self.SPACE
        kept[marks] = True
        wide = (raw >= 128) & kept
        where = np.cumsum(kept + wide.view(np.int8), dtype=np.int64) - 1
        out = np.empty(int(where[-1]) + 1, dtype="<u2")
        code = np.where(closes, self.tail[1][raw], self.tail[0][raw])
        code[marks] = self.MARK
        out[where[kept]] = code[kept]
        out[where[wide] - 1] = self.lead[raw[wide]]
        return out.tobytes().decode("utf-16-le")

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        held: list[bytes] = []
        size = 0

        def settle() -> None:
            nonlocal group, held, size
            if group:
                raw = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
                marks = np.cumsum([len(x) + 1 for x in held]) - 1
                ids = self.number[self.encoding.encode_to_numpy(self.coded(raw, marks), disallowed_special=())]
                ends = np.flatnonzero(ids == self.mark_id)
                packed, starts = ids.tobytes(), np.append(0, ends[:-1] + 1)
                for k, a, b in zip(group, starts.tolist(), ends.tolist()):
                    out[k] = packed[4 * a : 4 * b]
            group, held, size = [], [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            try:
                latin = text.encode("latin-1") if self.plain(text) else None
            except UnicodeEncodeError:
                latin = None
            if latin is None:
                out[k] = self.slow(text)
                continue
            group.append(k)
            held.append(latin)
            size += len(latin)
            if size >= GROUP_CHARS:
                settle()
        settle()
        return out


def encoder(path: str) -> LibraryEncoder:
    """The Python worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        kind = next((k for k in (ByteEncoder, WordEncoder) if k.takes(file)), LibraryEncoder)
        _LOADED[path] = kind(path, file)
    return _LOADED[path]

"""BPE encoding and decoding with a public tokenizer file, long unsplit text by tree concatenation."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from terrace.llm.common import held, map_arrow, text_slices, without

# The pattern of byte-level splitting, and Unicode's white space as the tokenizers library reads \\s.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_BYTES, ENTRY = 96 << 20, 64
"""Memory for the pre-tokens whose ids a worker remembers; what a dict takes for an entry, besides its key and value."""
LEAF, SPREAD = 4096, 1 << 16
"""Code points of a leaf; a text of more than SPREAD has its leaves encoded in many tasks, a shorter one in its own. The ids are the same either way."""
REACH = 4
"""A pre-token that ends so many code points before a text's end is the same whatever follows: the patterns look no further, and never back."""


def ranges(wanted: Callable[[str], bool]) -> str:
    """The code points of Unicode 3.2 (assigned, no surrogates) that are wanted, as ranges of a character class."""
    on = [unicodedata.ucd_3_2_0.category(c := chr(i)) not in ("Cn", "Cs") and wanted(c) for i in range(0x110000)]
    edges = [i for i in range(0x110000) if on[i] != (i > 0 and on[i - 1])] + [0x110000]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


@lru_cache(maxsize=1)
def letters_numbers() -> tuple[str, str]:
    return ranges(lambda c: unicodedata.category(c)[0] == "L"), ranges(lambda c: unicodedata.category(c)[0] == "N")


@lru_cache(maxsize=1)
def newer() -> re.Pattern:
    """Finds code points that Unicode 3.2 hasn't: of these, two libraries' tables may disagree on what is a letter."""
    return re.compile("[^" + ranges(lambda c: True) + "]")


class NewerText(Exception):
    """A pre-token has a code point that may be split elsewhere by the library."""


class Words(dict):
    """Ids of pre-tokens as bytes; each is encoded by the library when it's new. Two generations of `most` / 2 bytes: when one is full, it becomes the old one, and what is asked for again comes back from there. Those of over `longest` code points are never kept."""

    def __init__(self, encode: Callable[[str], list[int]], longest: int, most: int = WORD_BYTES):
        super().__init__()
        self.encode, self.longest, self.most, self.letters, self.used = encode, longest, most, byte_letters(), 0
        self.old: dict[str, bytes] = {}
        self.single: dict[int, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is not None:
            return self.keep(word, ids)
        if word.isascii():
            spelled = word.replace(" ", self.letters[32]) if word.isprintable() else word.translate(self.letters)
        elif newer().search(word):
            raise NewerText
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        found = self.encode(spelled)
        if len(found) == 1:  # one object for all pre-tokens that are this token
            ids = self.single.get(found[0]) or self.single.setdefault(found[0], array("I", found).tobytes())
        else:
            ids = array("I", found).tobytes()
        return self.keep(word, ids) if len(word) <= self.longest else ids

    def keep(self, word: str, ids: bytes) -> bytes:
        self.used += ENTRY + sys.getsizeof(word) + sys.getsizeof(ids)
        if 2 * self.used > self.most:
            self.old, self.used = dict(self), 0
            self.clear()
        self[word] = ids
        return ids


class Part:
    """An encoded stretch of a text: its pre-tokens, the bytes of ids of each, and the ids. words is what the pattern finds in text, so a join must keep that."""

    __slots__ = ("text", "words", "sizes", "ids")

    def __init__(self, text: str, words: list[str], sizes: list[int], ids: bytes):
        self.text, self.words, self.sizes, self.ids = text, words, sizes, ids

    def last(self, k: int) -> list[int]:
        """Where the last k pre-tokens begin: between them there is white space or nothing."""
        at, out = len(self.text), []
        for w in reversed(self.words[len(self.words) - k :]):
            at = self.text.rindex(w, 0, at)
            out.append(at)
        return out[::-1]

    def first(self, k: int) -> list[int]:
        at, out = 0, []
        for w in self.words[:k]:
            at = self.text.index(w, at)
            out.append(at)
            at += len(w)
        return out


def splitting_pattern(spec: dict) -> tuple[re.Pattern, re.Pattern] | None:
    """The patterns (of any text, of ASCII) whose matches are the byte-level pre-tokens; None for a tokenizer that splits in another way."""
    pre = spec["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers", [pre])
    first, rest = steps[0], steps[1:]
    if first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not rest:
        pattern = BYTE_LEVEL
    elif first.get("type") == "Split" and "Regex" in first["pattern"] and first["behavior"] == "Removed" and first["invert"] and len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not (rest[0]["use_regex"] or rest[0]["add_prefix_space"]):
        pattern = first["pattern"]["Regex"]
        if "(?<" in pattern or "[^\\s\\p{L}\\p{N}]+" not in pattern:  # it may look back, or leave out more than white space
            return None
    else:
        return None
    found = []
    for space, (letter, number) in ((SPACE, letters_numbers()), (r"\t-\r ", ("A-Za-z", "0-9"))):
        p = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        p = p.replace("[^\\s\\p{L}\\p{N}]", f"[^{space}{letter}{number}]").replace("\\p{L}", f"[{letter}]").replace("\\p{N}", f"[{number}]")
        found.append(re.compile(p.replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]")))
    return found[0], found[1]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible Latin-1, else the next one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in visible)}


class TreeEncoder:
    """Encodes as `Tokenizer.encode(text, add_special_tokens=False)` does.

    A text of more than `leaf` code points is cut into leaves, wherever the cut falls; the leaves are encoded by themselves (in one task or in many) and joined pairwise up a tree.
    At each join the last pre-tokens of the left and the first of the right are taken out and encoded again as one window, which doubles until it starts where the left side can't depend
    on the right any more and meets a place where the right side begins a pre-token as well: from there on the pattern, which never looks back, finds the same in both.
    A pre-token that is longer than a leaf itself is cut and joined alike, by tokens: the window doubles until its first token is the left side's own and its last
    the right side's own. A token sequence is the BPE encoding if and only if each two neighbours are, so agreement is exact.
    """

    def __init__(self, path: str, leaf: int = LEAF, most: int = WORD_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"truncation": None, "padding": None}
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("ids are written as this machine has them: little-endian, 32 bits")
        self.tok, self.leaf, self.joins = Tokenizer.from_str(json.dumps(spec)), leaf, 0
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.long = re.compile(r"\S{%d}" % (leaf + 1))
        self.path, self.name, self.pattern = path, self.tok.id_to_token, splitting_pattern(spec)
        model = self.tok.model
        self.words = Words(lambda w: self.tree(w) if len(w) > self.leaf else [t.id for t in model.tokenize(w)], leaf, most)

    @cached_property
    def plain(self) -> tuple:
        """Tokenizers of the model alone, for a piece that ends its pre-token and for one that doesn't; only pre-tokens of over a leaf need them."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = {"version": spec["version"], "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        last = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"]}))
        return last, Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}})) if self.suffix else last

    def normalized(self, text: str) -> str | None:
        """The text as the pattern splits it; None if the pattern can't, or might not split it as the library does (special tokens, code points younger than the tables)."""
        if self.pattern is None or self.added and self.added.search(text):
            return None
        plain = self.tok.normalizer.normalize_str(text) if self.tok.normalizer is not None else text
        return plain if plain.isascii() or not newer().search(plain) else None

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. A text that the pattern may split in another way than the library goes to the library."""
        if self.pattern is None or self.added and self.added.search(text):
            return self._whole(text)
        plain = self.tok.normalizer.normalize_str(text) if self.tok.normalizer is not None else text
        try:
            if len(plain) > self.leaf:
                return self.joined([self.part(plain[i : i + self.leaf]) for i in range(0, len(plain), self.leaf)]).ids
            return b"".join(map(self.words.__getitem__, self.pattern[plain.isascii()].findall(plain)))
        except NewerText:
            return self._whole(text)

    def part(self, text: str) -> Part:
        """A leaf."""
        words = self.pattern[text.isascii()].findall(text)
        each = list(map(self.words.__getitem__, words))
        return Part(text, words, list(map(len, each)), b"".join(each))

    def joined(self, row: list[Part]) -> Part:
        """The tree above the leaves of one text."""
        while len(row) > 1:
            row = [self.join_parts(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def join_parts(self, left: Part, right: Part) -> Part:
        """The encoding of two neighbours' text as one."""
        self.joins += 1
        cut, k = len(left.text), 4
        while True:
            a, b = min(k, len(left.words)), min(k, len(right.words))
            all_left, all_right = a == len(left.words), b == len(right.words)
            back, ahead = left.last(a), right.first(b)
            lo = 0 if all_left else back[0]
            end = len(right.text) if all_right else ahead[-1] + len(right.words[b - 1])
            window = left.text[lo:] + right.text[:end]
            found = [(lo + m.start(), m[0]) for m in self.pattern[window.isascii()].finditer(window)]
            meet = {cut + s: j for j, s in enumerate(ahead)}
            n = next((i for i, (s, _) in enumerate(found) if s in meet and s + REACH <= cut + end), None)
            if n is None and all_right:
                n, j = len(found), len(right.words)
            elif n is not None:
                j = meet[found[n][0]]
            if n is not None and (all_left or lo <= cut - REACH):
                break
            k *= 2
        inside, gone, kept = found[:n], sum(left.sizes[len(left.words) - a :]), sum(right.sizes[:j])
        each = []
        for at, w in inside:
            if len(w) > self.leaf and back and ahead and ahead[0] == 0 and at == back[-1] and w == left.words[-1] + right.words[0]:  # one pre-token across the cut: by its tokens
                ends = np.frombuffer(left.ids[len(left.ids) - left.sizes[-1] :], "<u4").tolist(), np.frombuffer(right.ids[: right.sizes[0]], "<u4").tolist()
                each.append(array("I", self.join(*ends, True)).tobytes())
            else:
                each.append(self.words[w])
        return Part(
            left.text + right.text, left.words[: len(left.words) - a] + [w for _, w in inside] + right.words[j:],
            left.sizes[: len(left.words) - a] + list(map(len, each)) + right.sizes[j:], b"".join((left.ids[: len(left.ids) - gone], *each, right.ids[kept:])),
        )

    def _whole(self, text: str) -> bytes:
        if self.long.search(text):
            return array("I", self.encode(text)).tobytes()
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(self.encode_bytes(t), "<u4").tolist() for t in texts]

    def encode(self, text: str) -> list[int]:
        """Any text, pre-token by pre-token."""
        ids: list[int] = []
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            ids += self._segment(text[at : m.start()])
            ids.append(self.tok.token_to_id(m[0]))
            at = m.end()
        return ids + self._segment(text[at:])

    def _segment(self, text: str) -> list[int]:
        if not text:
            return []
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        ids: list[int] = []
        for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            ids += self.tree(piece) if len(piece) > self.leaf else [t.id for t in self.tok.model.tokenize(piece)]
        return ids

    def _bpe(self, pieces: list[str], last: bool) -> list[list[int]]:
        return [e.ids for e in self.plain[not last].encode_batch(pieces, add_special_tokens=False)]

    def tree(self, piece: str) -> list[int]:
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        row = self._bpe(leaves[:-1], False) + self._bpe(leaves[-1:], True)
        while len(row) > 1:
            ends = len(row) - 1
            row = [self.join(row[i], row[i + 1], i + 1 == ends) if i < ends else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two encoded neighbours; last: the right one ends the pre-token. The left one may be encoded as if it did."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            ends = last and all_right
            window = "".join(map(self.name, a)).removesuffix(self.suffix) + "".join(map(self.name, b))
            new = self._bpe([window[: len(window) - len(self.suffix)] if ends else window], ends)[0]
            if (all_left or new[0] == a[0]) and (all_right or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            k *= 2

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


@held
def encoder(path: str, leaf: int = LEAF, most: int = WORD_BYTES) -> TreeEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return TreeEncoder(path, leaf, most)


BATCH_CHARS = 1 << 20


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """Of every row: the `keep` columns, ids (binary: little-endian unsigned 32-bit token ids) and decoded (the ids decoded again).

    path: a tokenizer file that every executor can open (it is never copied). Null and empty texts have no ids and decode to ''.
    Texts of more than `spread` code points are cut into leaves of `spread`, which are encoded as rows in any tasks and joined by growing windows where a text's leaves meet; only these texts are shuffled.
    Rows are independent, so copies and ties need no rule; columns beside `keep` are dropped, and a kept one named ids or decoded gives way.
    """
    return _mapped(docs, path, text_col, keep, leaf, spread, True)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """round_trip without decoded."""
    return _mapped(docs, path, text_col, keep, leaf, spread, False)


def _mapped(docs: DataFrame, path: str, text_col: str, keep: list[str] | None, leaf: int, spread: int, both: bool) -> DataFrame:
    keep = without([c for c in docs.columns if c != text_col] if keep is None else keep, "ids", *["decoded"] * both)
    df = docs.select(F.col(text_col).alias("_text"), F.struct(F.lit(True).alias("_"), *(F.col(c) for c in keep)).alias("kept"))
    long = F.coalesce(F.length("_text"), F.lit(0)) > spread
    kept = df.schema["kept"]
    out = StructType([kept, StructField("ids", BinaryType()), *[StructField("decoded", StringType())] * both])
    of_leaf = [StructField("rid", LongType()), StructField("nth", IntegerType()), StructField("leaf", StringType()), StructField("kept", kept.dataType)]

    def results(enc: TreeEncoder, kept: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        cols = [kept, pa.array(ids, pa.binary())]
        if both:
            cols.append(pa.array(enc.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids]), pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=["kept", "ids", *["decoded"] * both])

    def whole():
        enc = encoder(path, leaf)

        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(0), BATCH_CHARS):
                part = b.slice(lo, hi - lo)
                yield results(enc, part.column(1), [enc.encode_bytes(t or "") for t in part.column(0).to_pylist()])

        return f

    def cut():
        """A row for each leaf of a text, nth from 0, the kept columns with the first; a text that the pattern can't split goes on whole (nth -1)."""
        enc = encoder(path, leaf)

        def f(b: pa.RecordBatch):
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                plain = enc.normalized(text)
                leaves = [text] if plain is None else (plain[at : at + spread] for at in range(0, max(1, len(plain)), spread))
                for nth, x in enumerate(leaves):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([-1 if plain is None else nth], pa.int32()), pa.array([x], pa.string()), b.column(2).slice(i, 1) if nth == 0 else pa.nulls(1, b.column(2).type)], names=["rid", "nth", "leaf", "kept"])

        return f

    def leaves():
        enc = encoder(path, leaf)

        def f(b: pa.RecordBatch):
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                x = row.column(2)[0].as_py()
                if row.column(1)[0].as_py() < 0:
                    sizes, ids = b"", enc.encode_bytes(x)
                else:
                    p = enc.joined([enc.part(x[at : at + leaf]) for at in range(0, max(1, len(x)), leaf)])
                    sizes, ids = array("I", p.sizes).tobytes(), p.ids
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([sizes], pa.binary()), pa.array([ids], pa.binary())], names=["rid", "nth", "leaf", "kept", "sizes", "ids"])

        return f

    def joins():
        enc = encoder(path, leaf)

        def f(b: pa.RecordBatch):
            for i in range(b.num_rows):
                parts = []
                for x in b.column(1)[i]:
                    text, sizes = x["leaf"].as_py(), x["sizes"].as_py()
                    parts.append(Part(text, enc.pattern[text.isascii()].findall(text) if sizes else [], array("I", sizes).tolist(), x["ids"].as_py()))
                yield results(enc, b.column(0).slice(i, 1), [enc.joined(parts).ids if len(parts) > 1 else parts[0].ids])

        return f

    short = map_arrow(df.where(~long), out, whole)
    rows = map_arrow(df.where(long).select(F.monotonically_increasing_id().alias("rid"), "_text", "kept"), StructType(of_leaf), cut)
    dealt = map_arrow(rows.repartition("rid", "nth"), StructType([*of_leaf, StructField("sizes", BinaryType()), StructField("ids", BinaryType())]), leaves)
    texts = dealt.groupBy("rid").agg(F.max_by("kept", F.col("kept").isNotNull()).alias("kept"), F.array_sort(F.collect_list(F.struct("nth", "leaf", "sizes", "ids"))).alias("parts"))
    full = short.union(map_arrow(texts.select("kept", "parts"), out, joins))
    return full.select(*(F.col("kept").getField(c).alias(c) for c in keep), "ids", *["decoded"] * both)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns and decoded, the text of ids_col (binary as of encode; null: '')."""
    keep = without([c for c in docs.columns if c != ids_col] if keep is None else keep, "decoded")
    df = docs.select(F.col(ids_col).alias("_ids"), *(F.col(c) for c in keep))

    def make():
        enc = encoder(path)

        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(0), 4 * BATCH_CHARS):
                part = b.slice(lo, hi - lo)
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(enc.decode_batch(ids), pa.string())], names=[*keep, "decoded"])

        return f

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[1:])
    return map_arrow(df, f"{kept}, decoded string", make)

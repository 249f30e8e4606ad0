"""Token counts of a byte-level BPE vocabulary, without merging what is a token already.

A text is cut into pre-tokens, and each is merged by itself. ``proof`` finds out before the run
which strings of the vocabulary merge to one token when they stand alone: by merging every one of
them. In the run, a pre-token that is such a string counts one without merging; the rest alone, few
as they are, go through the merges. Nothing is shuffled.

The classes of characters at which texts are cut are the vocabulary's library's own: ``proof`` asks
it for the class of every code point, and texts with code points of which ``regex`` thinks otherwise
are cut by a pattern that says so.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written

#: Fixed value: how texts are cut, with L, N and S for the classes of letters, numbers and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^SLN]+|S+(?![^S])|S+"
#: Texts of more characters are cut piece by piece, so that no list of all their pre-tokens is held; words whose merges a task remembers at most.
LONG, REMEMBERED = 1 << 20, 1 << 19


@dataclass(frozen=True)
class Proof:
    """alone: strings of the vocabulary that are one token when they stand alone; special: strings that are a token wherever they occur; exact: the pattern with the library's classes; odd: characters that only it has right."""

    path: str
    alone: frozenset
    special: tuple
    exact: str
    odd: str


def alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable ones of Latin-1 for themselves, the others by turn from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def classes(pieces) -> dict[str, set[int]]:
    """The library's letters, numbers and white space: a character is of the class of another if it goes on that one's piece. ``pieces`` are its pieces of a text, as (string, (begin, end))."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    goes_on = {"L": set(), "N": set(), "other": set()}
    first = {"L": "a", "N": "1", "other": "!"}
    for i in range(0, len(points), 256):
        part = points[i : i + 256]
        text = "".join(map(chr, part))
        whole = next((kind for kind, c in first.items() if len(pieces(c + text)) == 1), None)
        if whole:
            goes_on[whole].update(part)
            continue
        for kind, c in first.items():
            # every character stands behind one of the class, and pairs begin where a piece begins
            pair = ("!" if kind != "other" else "a") + c
            begins = {at for _, (at, _) in pieces("".join(pair + chr(x) for x in part))}
            goes_on[kind].update(x for j, x in enumerate(part) if 3 * j + 2 not in begins)
    return {"L": goes_on["L"], "N": goes_on["N"], "S": set(points) - goes_on["L"] - goes_on["N"] - goes_on["other"]}


def ranges(points: set[int]) -> str:
    """Inside of a character class."""
    out, left = [], sorted(points)
    while left:
        n = next((i for i in range(1, len(left)) if left[i] != left[0] + i), len(left))
        out.append(f"\\U{left[0]:08x}-\\U{left[n - 1]:08x}")
        left = left[n:]
    return "".join(out)


def pattern(letters: str, numbers: str, space: str) -> str:
    return PATTERN.replace("[^SLN]", f"[^{space}{letters}{numbers}]").replace("[^S]", f"[^{space}]").replace("S+", f"[{space}]+").replace("L+", f"[{letters}]+").replace("N+", f"[{numbers}]+")


PLAIN = pattern(r"\p{L}", r"\p{N}", r"\s")
ASCII = pattern("A-Za-z", "0-9", "\\t-\\r ")


@functools.lru_cache(4)
def proof(path: str) -> Proof:
    """What is known of a vocabulary before the run; fails if the file is not a byte-level BPE of the kind that this module counts."""
    kind = json.load(open(path, encoding="utf-8"))
    model, before, added = kind["model"], kind["pre_tokenizer"], kind["added_tokens"]
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or kind["normalizer"] or any(a[x] for a in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    library = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in alphabet().items()}
    alone = set()
    for token in model["vocab"]:
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not a byte-level string, or no whole characters: no pre-token is equal to it
        if len(library.model.tokenize(token)) == 1:
            alone.add(text)
    own = classes(library.pre_tokenizer.pre_tokenize_str)
    sets, odd = {}, set()
    for name, theirs in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        known = {ord(c) for c in regex.findall(theirs, "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000))))}
        more, less = own[name] - known, known - own[name]
        odd |= more | less
        sets[name] = f"[[{theirs}{ranges(more)}]{f'--[{ranges(less)}]' if less else ''}]"
    return Proof(path, frozenset(alone), tuple(a["content"] for a in added), pattern(sets["L"], sets["N"], sets["S"]), f"[{ranges(odd)}]" if odd else "")


def counter(known: Proof):
    """A function from a text to its number of tokens."""
    bytes_of = {b: c for b, c in alphabet().items()}
    library = Tokenizer.from_file(known.path)
    plain, ascii_only = regex.compile(PLAIN), re.compile(ASCII)
    exact = regex.compile(known.exact, regex.V1) if known.odd else plain
    odd = re.compile(known.odd) if known.odd else None
    special = re.compile("|".join(map(re.escape, known.special))) if known.special else None
    alone, merged = known.alone, {}

    def rest(words: list[str]) -> int:
        """Tokens of words that have to be merged."""
        total = 0
        for word in words:
            n = merged.get(word)
            if n is None:
                n = len(library.model.tokenize(word.encode().decode("latin-1").translate(bytes_of)))
                if len(merged) >= REMEMBERED:
                    merged.clear()
                if len(word) < 256:
                    merged[word] = n
            total += n
        return total

    def piece(text: str) -> int:
        cut = ascii_only if text.isascii() else exact if odd and odd.search(text) else plain
        if len(text) <= LONG:
            words = cut.findall(text)
            more = [w for w in words if w not in alone]
            return len(words) - len(more) + rest(more)
        return sum(1 if (w := m.group()) in alone else rest([w]) for m in cut.finditer(text))

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return piece(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(piece, parts))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text, under the vocabulary in ``path`` (a file that every executor has).

    Counts are those of the ``tokenizers`` library without added tokens; its special strings inside
    a text are a token each. A null text is an empty one; rows stay apart whether or not ids repeat
    or are null, and other columns do not matter. Bytes that are no UTF-8 count as replacement
    characters, three bytes each.
    """
    known = proof(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(known)
            texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in batch.column(1)]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            found = pa.array(map(count, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), found], names=["id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = written(own.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint"), "tokens")
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

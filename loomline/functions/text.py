"""Text functions; all but the Unicode normal forms are native expressions."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType

# Patterns that results depend on.
PROTECTED = r"(?i)(?:(?<![0-9A-Za-z])\d+(?:\.\d+)*(?![0-9A-Za-z])|\b(?:not|never|unsupported|required)\b|금지|아니|않|불가|제외|미지원|필수)"
TOKEN = r"[0-9A-Za-z가-힣._/-]{2,}"
TAG = r"[0-9A-Za-z가-힣][0-9A-Za-z가-힣._+-]{1,31}"
FRESHNESS = r"(?i)(?:\b20\d{2}\b|\bv?\d+(?:\.\d+){1,3}\b|지원|버전|최신|현재|deprecated|deprecat|support|require|default|legacy)"
SENSITIVE = (
    r"(?i)(?:\b[A-Z0-9_.-]*(?:token|password|passwd|secret|api[_-]?key|private[_-]?key)[A-Z0-9_.-]*\s*[:=]"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\b[0-9a-f]{32,}\b|\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
    r"|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[^\s]+\.(?:internal|local)\b)"
)
SOURCE_MARK = r"\[source:([^\]\r\n]+)\]"
INTERNAL_MARK = r"\[(?:claim|evidence):[^\]\r\n]+\]"
HEADING = r"(?m)^(#{1,6})\s+(.+?)\s*$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Normal form C; plain ASCII is in it, and is not sent to Python."""
    return F.coalesce(_nfc(F.when(F.octet_length(c) != F.length(c), c)), c)


@F.pandas_udf(StringType())
def topic_key(s: pd.Series) -> pd.Series:
    """NFKC, case folding, collapsed white space."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize(c: Column) -> Column:
    return nfc(newlines(c))


def normalized(s: str) -> str:
    """``normalize`` of one text, in Python."""
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding changes beyond lower case, by rule: to one character, and to several (below U+0590 and ligatures)."""
    odd = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold()}
    return {c: f for c, f in odd.items() if len(f) == 1}, {c: f for c, f in odd.items() if len(f) > 1 and (ord(c) < 0x590 or 0xFB00 <= ord(c) < 0xFB18)}


_ONE, _SEVERAL = _folds()


def _among(letters) -> str:
    """A class of letters; most characters fall out by the first, short part of it."""
    far = min((c for c in letters if ord(c) > 0xFF), default="")
    near = [c for c in letters if ord(c) <= 0xFF]
    return "[" + "".join(near) + (f"{far}-\uffff&&[{''.join(letters)}]" if far else "") + "]"


def fold(c: Column) -> Column:
    """Case folding without Python; Greek letters with a subscript iota keep their one character.

    Plain ASCII is lower-cased and no more.  Else single letters are translated if any is there,
    and of the letters that become several the sharp s is tried first, the rare ones together.
    """
    low = F.lower(c)
    one = F.when(low.rlike(_among(_ONE)), F.translate(low, "".join(_ONE), "".join(_ONE.values()))).otherwise(low)
    sharp = F.replace(one, F.lit("ß"), F.lit("ss"))
    rare = {k: v for k, v in _SEVERAL.items() if k != "ß"}
    full = sharp
    for letter, letters in rare.items():
        full = F.replace(full, F.lit(letter), F.lit(letters))
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(F.when(sharp.rlike(_among(rare)), full).otherwise(sharp))


def lower(c: Column) -> Column:
    """SQL's lower case: each letter becomes one, wherever it stands, and the sharp s stays."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def alphanumerics(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def protected_terms(c: Column) -> Column:
    return F.array_sort(F.transform(found(c, PROTECTED), fold))


def shingles(c: Column) -> Column:
    """Distinct character 3-grams; a shorter text is one shingle, an empty one has none."""
    n = F.length(c)
    grams = found(c, "(?s)(?=(...)).", 1)  # one pass; a lambda would work ``c`` out for each gram
    return F.when(n > 2, F.array_distinct(grams)).when(n > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lexical_tokens(c: Column) -> Column:
    return F.array_distinct(found(fold(c), TOKEN))


def longest_tokens(c: Column, n: int = 8) -> Column:
    """The n longest tokens, ties by token."""
    keyed = F.sort_array(F.transform(lexical_tokens(c), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    return F.slice(keyed, 1, n).getField("t")


def minhash(shingle_array: Column, seeds: int = 8) -> Column:
    """For each seed the least SHA-256 of ``seed:shingle``.

    The law of collisions is that of any keyed hash; the values, and so the members of a
    block, are those of SHA-256 over letters and digits, not of the reference's hash.
    """

    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingle_array, lambda s: F.sha2(F.concat(F.lit(f"{seed}:"), s), 256)))

    return F.array(*[least(k) for k in range(seeds)])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``jaccard`` of the ``shingles`` of two texts, with the shingles of each text of a batch made once."""
    grams = {t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set() for t in {*a, *b}}

    def one(x: str, y: str) -> float:
        shared = len(grams[x] & grams[y])
        union = len(grams[x]) + len(grams[y]) - shared
        return shared / union if union else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


_gram_hashes: dict[int, list[int]] = {}


@F.pandas_udf(BinaryType())
def signature(s: pd.Series) -> pd.Series:
    """The first 8 bytes of each of the 8 hashes of ``minhash`` over ``shingles``, as one key; empty text has none.

    Each distinct shingle of a batch is hashed once.
    """
    chars = [np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for x in s]
    grams = []
    for c in chars:
        c = np.concatenate([c, np.zeros(max(0, 3 - len(c)) * (len(c) > 0), np.uint64)])
        grams.append(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] if len(c) else c)
    size = np.array([len(g) for g in grams], np.int64)
    out = np.full(len(s), b"", object)
    if size.sum():
        found_, at = np.unique(np.concatenate(grams), return_inverse=True)
        if len(_gram_hashes) > 1_000_000:
            _gram_hashes.clear()
        for g in found_.tolist():
            if g not in _gram_hashes:
                t = "".join(chr(x) for x in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if x).encode("utf-8", "surrogatepass")
                _gram_hashes[g] = [int.from_bytes(hashlib.sha256(b"%d:" % k + t).digest()[:8], "big") for k in range(8)]
        table = np.array([_gram_hashes[g] for g in found_.tolist()], np.uint64)
        full = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        least = np.stack([np.minimum.reduceat(table[at, k], starts) for k in range(8)], 1).astype(">u8")
        for i, row in zip(full, least):
            out[i] = row.tobytes()
    return pd.Series(out)


def strip_heading_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s{0,3}#{1,6}\s*", "")


def prose_fingerprint(block: Column) -> Column:
    """Null for short or structural blocks, else folded text without source marks."""
    structural = F.exists(F.split(block, "\n"), lambda x: F.ltrim(x).rlike(r"^(?:#|```|~~~|\||>|- |\* |\+ )"))
    return F.when((F.length(block) >= 60) & ~structural, squeezed(fold(F.regexp_replace(block, SOURCE_MARK, ""))))


def observed_prose(block: Column) -> Column:
    """The observer's own test: first-line prefixes only."""
    return F.when((F.length(block) >= 60) & ~block.rlike(r"^\s*(?:#|```|~~~|\||- )"), squeezed(fold(F.regexp_replace(block, SOURCE_MARK, ""))))


def without_internal_marks(c: Column) -> Column:
    c = F.regexp_replace(c, INTERNAL_MARK, "")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return F.concat(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$", "$1")


def citation_base(c: Column) -> Column:
    """A citation without its trailing ordinal."""
    return F.regexp_replace(c, r"\s*/\s*\d+\s*$", "")


def is_sensitive(c: Column) -> Column:
    return c.rlike(SENSITIVE)


def is_fresh(c: Column) -> Column:
    return c.rlike(FRESHNESS)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem_title(path: Column) -> Column:
    return F.replace(F.regexp_replace(basename(path), r"\.[^.]+$", ""), F.lit("-"), F.lit(" "))


def quantization(name: Column) -> Column:
    """Bits named in a model's name, or null."""
    bits = F.regexp_extract(F.lower(name), r"(?:^|[-_])(\d+)[-_]?bit(?:$|[-_])", 1)
    return F.when(bits != "", F.concat(bits, F.lit("-bit")))

"""Names, addresses, shingles and trigrams as Catalyst expressions; alignment ratios as Arrow functions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Question words that are no names.
STOP = ("who", "what", "when", "where", "how", "why", "did", "does", "the")
#: An address, the weights of whole, last and first names, and the score of a first name that begins the other.
ADDRESS = r"[\w.+-]+@[\w-]+\.[\w.-]+"
WEIGHTS, NICK_SCORE = (0.4, 0.3, 0.3), 0.9


def collapse(s: Column) -> Column:
    """White space collapsed and cut at both ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def char_shingles(text: Column, k: int = 5) -> Column:
    """The distinct k-character shingles of the lower-cased, trimmed text; a shorter text is one shingle."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    # one pass over the text: substring() would walk it again for each shingle; no match starts inside a code point
    found = F.regexp_extract_all(t, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % k), F.lit(1))
    return F.when(F.length(t) < k, F.array(t)).otherwise(F.array_distinct(found))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; of two empty sets: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def email_addresses(aliases: Column) -> Column:
    """The first address in each alias, lower-cased, without repeats."""
    found = F.transform(aliases, lambda a: F.regexp_extract(F.lower(F.coalesce(a, F.lit(""))), "(?U)" + ADDRESS, 0))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def name_parts(name: Column) -> Column:
    """struct(first, last), lower case, of "Last, First" or "First ... Last"; a single token is a first name."""
    plain = F.lower(collapse(F.coalesce(name, F.lit(""))))
    tokens = F.split(plain, " ")
    one, last = F.trim(F.substring_index(plain, ",", 1)), F.lit("")
    swapped = F.contains(plain, F.lit(","))
    rest = F.trim(F.regexp_extract(plain, "^[^,]*,(.*)$", 1))
    return F.when(swapped, F.struct(rest.alias("first"), one.alias("last"))).otherwise(
        F.struct(F.get(tokens, F.lit(0)).alias("first"), F.when(F.size(tokens) > 1, F.element_at(tokens, -1)).otherwise(last).alias("last"))
    )


def trigrams(text: Column) -> Column:
    """The set of trigrams of the alphanumeric words, each with two blanks before and one behind it."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def candidate_names(question: Column) -> Column:
    """Capitalised phrases, then single capitalised words that are no question words; in order, without repeats."""
    q, edge, end = F.coalesce(question, F.lit("")), r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    phrases = F.regexp_extract_all(q, F.lit(edge + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)" + end), F.lit(1))
    single = F.regexp_extract_all(q, F.lit(edge + r"([A-Z][a-z]{2,})" + end), F.lit(1))
    return F.array_distinct(F.concat(phrases, F.filter(single, lambda w: ~F.lower(w).isin(*STOP))))


def clean_aliases(aliases: Column) -> Column:
    """Trimmed, without empty ones; of aliases that differ in case alone the first stays."""
    some = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    lower = F.transform(some, lambda a: F.lower(a))
    return F.filter(some, lambda a, i: F.array_position(lower, F.lower(a)) == i + 1)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit a character of ``a``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; of two empty strings: 1."""
    if not a or not b:
        return float(a == b)
    return 2 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of its length (shorter at the ends) of the longer one."""
    return _partial(a, b, 2.0)


def partial_ratio_at_least(a: str, b: str, least: float) -> bool:
    """Whether ``partial_ratio`` reaches ``least``; windows whose letters cannot reach it are passed over."""
    return _partial(a, b, least) >= least


def _partial(a: str, b: str, enough: float) -> float:
    """The best window's ratio, or the first that is ``enough``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    wanted, inside, shared, best = Counter(a), Counter(), 0, 0.0
    least = enough if enough <= 1 else 0.0
    for i in range(1 - len(a), len(b)):
        # letters that window and string share bound the common subsequence
        if i + len(a) <= len(b):
            x = b[i + len(a) - 1]
            inside[x] += 1
            shared += inside[x] <= wanted[x]
        if i > 0:
            x = b[i - 1]
            shared -= inside[x] <= wanted[x]
            inside[x] -= 1
        size = len(a) + min(i + len(a), len(b)) - max(i, 0)
        if 2 * shared / size > best and 2 * shared / size >= least:
            best = max(best, ratio(a, b[max(i, 0) : i + len(a)]))
            if best >= enough:
                return best
    return best


def _parts(name: str) -> tuple[str, str]:
    """``name_parts`` of one name."""
    if "," in name:
        last, first = name.lower().split(",", 1)
        return first.strip(), last.strip()
    tokens = name.lower().split()
    return (tokens[0] if tokens else "", tokens[-1] if len(tokens) > 1 else "")


def similarity(a: str, b: str) -> float:
    """0.4 full names, 0.3 last names, 0.3 first names (0.9 where one begins the other)."""
    (fa, la), (fb, lb) = _parts(a), _parts(b)
    last = 0.0 if not la or not lb else 1.0 if la == lb else ratio(la, lb)
    first = 0.0 if not fa or not fb else NICK_SCORE if fa.startswith(fb) or fb.startswith(fa) else ratio(fa, fb)
    return WEIGHTS[0] * ratio(a.lower(), b.lower()) + WEIGHTS[1] * last + WEIGHTS[2] * first


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Batches of names compared by ``similarity``; a null counts as empty."""
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

"""Quality rules by distribution divergence, with Spark expressions only.

Two histograms of each document, of character classes and of the common words of its language, are compared with the mean
histograms of that language over the whole table (Jensen-Shannon distance, base 2, 0 to 1). A document fails if one of
them is too far away; documents of few words are not judged by distance. References are one row per listed language and
one for all others, whatever the table's size.

Defined results: a null or empty text has no words and fails the base rule; a null or unlisted language is compared with
the reference of all unlisted ones; repeated rows are judged alike; an empty table gives an empty result; other columns
pass through ``rules`` unread, but those of the names it adds give way; texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, plus

#: Frequent words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
}
OTHER = "*"
MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 50, 0.3, 0.45
#: Of the reference's share of common words; most of the mass is other words, so the distance hardly shows that common ones lack.
LEAST_COMMON = 0.1

_UPPER, _DIGIT, _MARK = "[A-Z]", "[0-9]", r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]"""
_SYMBOL = "[#*$%&|<>]"


def _list_of(lang: str) -> list[str]:
    return COMMON[lang] if lang != OTHER else sorted({w for ws in COMMON.values() for w in ws})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def _word_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words."""

    def counts(listed: list[str]) -> Column:
        return let(F.filter(words, lambda x: x.isin(listed)), lambda c: F.array(*[F.size(c) - F.size(F.array_remove(c, w)) for w in listed], F.size(words) - F.size(c)))

    out = counts(_list_of(OTHER))
    for name in COMMON:
        out = F.when(lang == name, counts(_list_of(name))).otherwise(out)
    return out


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows that stand in the array twice or more."""

    def union(at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(window), lambda n, k: n + F.least(F.lit(window), F.get(at, k) - F.get(at, k - 1)))

    def spread(pairs: Column) -> Column:
        same = lambda k, by: F.coalesce(F.get(pairs, k + by)["h"] == F.get(pairs, k)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, -1) | same(k, 1))
        return let(F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["i"])), union)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, spread))

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashed, of))


def _rare(text: Column) -> Column:
    """The text without small letters, white space and all that is not ASCII: a short string to count in."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+|[^\x00-\x7F]+", "")


def _char_counts(text: Column, rare: Column, word_chars: Column, symbols: Column) -> Column:
    """Counts of upper case, digits, marks, symbols, white space, what UTF-8 adds for other letters, and the rest."""
    upper, digit, mark = (F.regexp_count(rare, F.lit(p)) for p in (_UPPER, _DIGIT, _MARK))
    blank, wide = F.length(text) - word_chars, F.octet_length(text) - F.length(text)

    def all_of(c: Column) -> Column:
        rest = F.greatest(F.length(text) - F.aggregate(c, F.lit(0), lambda a, x: a + x), F.lit(0))
        return F.concat(c, F.array(rest))

    return let(F.array(upper, digit, mark, symbols, blank, wide), all_of)


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    def terms(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(b * 2 / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, terms), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


MEASURES = "_measures"


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with one small struct: everything that references and verdicts need, so that each text is read once."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(lang).isin(list(COMMON)), F.col(lang)).otherwise(OTHER)
    spoken = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(w: Column, rare: Column) -> Column:
        chars, symbols = F.length(F.array_join(w, "")), F.regexp_count(rare, F.lit(_SYMBOL))
        dup = let(spoken, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
        counts = {"n_words": F.size(w), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated_words(w)}
        return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()], _share(_char_counts(body, rare, chars, symbols)).alias("char_share"), _share(_word_counts(w, key)).alias("word_share"), key.alias("key"))

    return docs.withColumn(MEASURES, let(words_of(body), lambda w: let(_rare(body), lambda rare: measured(w, rare))))


def references(measured: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, char_ref, word_ref): mean histograms over all documents that are long enough; at most one row per key."""
    wide = max(len(_list_of(k)) for k in [*COMMON, OTHER]) + 1
    m = F.col(MEASURES)
    mean = lambda own, i: F.avg(F.get(m[own], F.lit(i)))
    agg = measured.filter(m["n_words"] >= min_words).groupBy(m["key"].alias("_key")).agg(*[mean("char_share", i).alias(f"c{i}") for i in range(7)], *[mean("word_share", i).alias(f"w{i}") for i in range(wide)])
    full = F.array(*[f"w{i}" for i in range(wide)])
    return agg.select("_key", F.array(*[f"c{i}" for i in range(7)]).alias("_char_ref"), F.filter(full, lambda x: x.isNotNull()).alias("_word_ref"))


def verdict(measured: DataFrame, refs: DataFrame, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, least_common: float = 0.0) -> DataFrame:
    """``measured`` without its struct, with the columns that ``rules`` adds."""
    m = F.col(MEASURES)
    # at most len(COMMON) + 1 rows, by the grouping above
    scored = measured.join(F.broadcast(refs), m["key"] == F.col("_key"), "left")
    judged = (m["n_words"] >= min_words) & F.col("_key").isNotNull()
    far = lambda own, ref: F.when(judged, js_distance(m[own], F.col(ref))).otherwise(0.0)
    common = lambda shares: 1 - F.element_at(shares, -1)
    ratio = F.when(judged & (common(F.col("_word_ref")) > 0), common(m["word_share"]) / common(F.col("_word_ref"))).otherwise(1.0)
    found = {c: m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    found |= {"char_distance": far("char_share", "_char_ref"), "word_distance": far("word_share", "_word_ref"), "common_ratio": ratio}
    found["base_failed"] = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    found["kept"] = ~found["base_failed"] & (found["char_distance"] <= max_char) & (found["word_distance"] <= max_word) & (ratio >= least_common)
    return plus(scored, **found).drop("_key", MEASURES, "_char_ref", "_word_ref")


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", refs: DataFrame | None = None, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, least_common: float = 0.0, keep_text: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, common_ratio, base_failed, kept.

    A column of docs of one of these names gives way. ``common_ratio`` is the share of common words by that of the reference;
    with ``least_common`` a judged text below it fails. Texts are read once: what is measured of them is written to the shared
    folder, with the other columns of docs and, with ``keep_text``, the text."""
    measured = measure(docs, text, lang)
    measured = materialize(measured if keep_text else measured.drop(text), "quality-measures")
    return verdict(measured, references(measured, min_words) if refs is None else refs, min_words, max_char, max_word, least_common)

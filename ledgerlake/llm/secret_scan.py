"""Secret scan by a battery of randomness tests, with Spark expressions only.

Base kinds are patterns. The method looks at every long run of encoding characters. An encoding is inferred, and three tests of
the run's places in its alphabet are made: chi-squared over the whole alphabet, the runs test about the alphabet's middle, and
the lag-1 serial correlation. A run is random if

* none of the three rejects a uniform source (Bonferroni's p of at least UNIFORM_P), and
* its chi-squared is too small for plain text: under text in which two places agree with the probability COINCIDENCE, it is
  noncentral chi-squared, and the p-value is the lower tail of that. It falls with the run's length. Of the runs of one document
  those are reported whose p-value a Benjamini-Hochberg step admits, in which each run weighs as its length, so that short runs
  have to be stranger than long ones.

Defined results: a null text is empty and has no spans; overlapping runs of the method give way to base spans; repeated
rows give equal results; an empty table gives an empty result; other columns pass through unread, but those of the names that
``scan`` adds give way; texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, plus

#: The base kinds in their order, pattern, group whose length counts, least length. A run of one class that is long
#: enough is what a repeated class with that least length finds.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Encodings in order of inference: name, pattern of a whole run, alphabet, how often two places agree in plain text.
ENCODINGS = [
    ("hex", "[0-9a-f]+", "0123456789abcdef", 0.1),
    ("hex_upper", "[0-9A-F]+", "0123456789ABCDEF", 0.1),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.05),
    ("base64", "[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05),
    ("base64url", "[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.05),
]
#: A run of fewer characters is no candidate; below it the tests' approximations do not hold.
LEAST, UNIFORM_P, FALSE_RATE = 20, 0.001, 0.01
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}=*"
_SPAN = "array<struct<start:int,end:int,kind:int>>"
_CHUNK = 256


def running_sums(sizes: Column) -> Column:
    """Sums of an array's numbers up to each, chunk by chunk, so that a long array is not copied for every element."""

    def of(sums: Column) -> Column:
        def chunk(c: Column) -> Column:
            before = F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda a, x: a + x)
            grown = F.aggregate(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)), F.array(before), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
            return F.slice(grown, F.lit(2), F.size(grown))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(sums) - 1), chunk))

    count = F.ceil(F.size(sizes) / F.lit(_CHUNK)).cast("int")
    sums = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.aggregate(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)), F.lit(0), lambda a, x: a + x))
    return let(sums, of)


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with places, from the matches and what stands between them."""

    def placed(found: Column, parts: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))

        def cut(ends: Column) -> Column:
            long = lambda m: (F.length(F.regexp_extract(m, pattern, group)) if group else F.length(m)) >= least
            span = lambda m, i: F.when(long(m), F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind")))
            return F.filter(F.transform(found, span), lambda s: s.isNotNull())

        return let(sizes, lambda z: let(running_sums(z), cut))

    none = F.array().cast(_SPAN)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda parts: placed(found, parts))))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by the formula 26.2.17 of Abramowitz and Stegun."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_z(x: Column, df: Column) -> Column:
    """Wilson and Hilferty's normal deviate of a chi-squared."""
    return (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def battery(run: Column) -> Column:
    """struct<plain,uniform>: the p-values of plain text and of a uniform source; 1 and 0 where no encoding fits."""
    bare = F.rtrim(run, F.lit("="))
    chosen = F.lit(None).cast("struct<alphabet:string,coincidence:double>")
    for _, pattern, letters, same in reversed(ENCODINGS):
        chosen = F.when(bare.rlike(f"^{pattern}$"), F.struct(F.lit(letters).alias("alphabet"), F.lit(same).alias("coincidence"))).otherwise(chosen)

    def tests(x: Column, k: Column, same: Column) -> Column:
        n = F.size(x)

        def runs(high: Column) -> Column:
            def z(n1: Column) -> Column:
                n2 = n - n1
                mean = 2.0 * n1 * n2 / n + 1
                var = (mean - 1) * (mean - 2) / (n - 1)
                changes = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(1), lambda s, i: s + F.abs(F.get(high, i) - F.get(high, i - 1)))
                return F.when((n1 == 0) | (n2 == 0) | (var <= 0), F.lit(0.0)).otherwise(2 * _normal_tail(F.abs(changes - mean) / F.sqrt(F.when(var > 0, var).otherwise(1.0))))

            return let(F.aggregate(high, F.lit(0), lambda s, v: s + v), z)

        def serial(d: Column) -> Column:
            whole = F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v)
            lag = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + F.get(d, i) * F.get(d, i - 1))
            return F.when(whole <= 0, F.lit(0.0)).otherwise(2 * _normal_tail(F.abs(lag / F.when(whole > 0, whole).otherwise(1.0) + F.lit(1.0) / n) * F.sqrt(n.cast("double"))))

        def both(chi: Column) -> Column:
            df = (k - 1).cast("double")
            # Patnaik: a noncentral chi-squared as a multiple of a central one
            shift = n * (k * same - 1)
            scale, freedom = (df + 2 * shift) / (df + shift), (df + shift) * (df + shift) / (df + 2 * shift)
            plain = 1 - _normal_tail(_chi_z(chi / scale, freedom))
            high = F.transform(x, lambda v: F.when(v * 2 >= k, 1).otherwise(0))
            average = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
            dev = let(average, lambda m: F.transform(x, lambda v: v - m))
            uniform = F.least(F.lit(1.0), 3 * F.least(_normal_tail(_chi_z(chi, df)), let(high, runs), let(dev, serial)))
            return F.struct(plain.alias("plain"), uniform.alias("uniform"))

        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, v: let(F.size(F.filter(x, lambda u: u == v)), lambda c: s + c * c))
        return let(squares * k / n - n, both)

    marks = lambda e: F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.instr(e["alphabet"], c) - 1)
    nothing = F.struct(F.lit(1.0).alias("plain"), F.lit(0.0).alias("uniform"))
    return let(chosen, lambda e: F.when(e.isNull(), nothing).otherwise(let(marks(e), lambda x: tests(x, F.length(e["alphabet"]), e["coincidence"]))))


def _random(text: Column, base: Column, kind: int) -> Column:
    spans = _spans(text, kind, RUN, 0, LEAST)
    free = lambda ss: F.filter(ss, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def tested(s: Column) -> Column:
        fields = lambda p: F.struct(p["plain"].alias("p"), (s["end"] - s["start"]).alias("w"), (p["uniform"] >= UNIFORM_P).alias("uniform"), s.alias("span"))
        return let(battery(F.substr(text, s["start"] + 1, s["end"] - s["start"])), fields)

    def admitted(ts: Column) -> Column:
        total = F.aggregate(ts, F.lit(0), lambda a, t: a + t["w"])

        def limit(total: Column) -> Column:
            start = F.struct(F.lit(0).alias("w"), F.lit(-1.0).alias("p"))
            step = lambda a, t: F.struct((a["w"] + t["w"]).alias("w"), F.when(t["p"] * total <= FALSE_RATE * (a["w"] + t["w"]), t["p"]).otherwise(a["p"]).alias("p"))
            return F.aggregate(ts, start, step)["p"]

        return let(let(total, limit), lambda most: F.transform(F.filter(ts, lambda t: t["uniform"] & (t["p"] <= most)), lambda t: t["span"]))

    return let(spans, lambda ss: F.when(F.size(ss) == 0, ss).otherwise(let(F.sort_array(F.transform(free(ss), tested)), admitted)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and random_spans: array<struct<start,end,kind>> in code points; kind counts KINDS, then random."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.concat(*[_spans(body, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]))
    both = let(base, lambda b: F.struct(b.alias("base_spans"), _random(body, b, len(KINDS)).alias("random_spans")))
    return plus(docs.withColumn("_spans", both), base_spans=F.col("_spans.base_spans"), random_spans=F.col("_spans.random_spans")).drop("_spans")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

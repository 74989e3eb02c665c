"""The subpackage's queries against DuckDB where they have SQL, and the pipeline's promises, on the smallest tables."""

import random
import re
from collections import Counter
from decimal import Decimal
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlake.llm import quality_rules, registry
from ledgerlake.llm.q_op6 import tokenizer_path

from .test_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    clean = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(clean(plain(r[i])) for i in at) for r in found), key=repr)


# ---- the pipeline, stage by stage, against plain Python over the same input -------------------------------------------------
def brute_quality(docs):
    q = quality_rules
    share = lambda c: [x / sum(c) if sum(c) else 0.0 for x in c]
    measured = []
    for d in docs:
        t = d["text"] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        key = d["lang"] if d["lang"] in q.COMMON else q.OTHER
        count = [len(re.findall(p, t)) for p in (q._UPPER, q._DIGIT, q._MARK, q._SYMBOL)]
        count += [len(t) - sum(map(len, words)), len(t.encode()) - len(t)]
        listed = q._list_of(key)
        common = [words.count(w) for w in listed]
        measured.append((words, key, share([*count, max(len(t) - sum(count), 0)]), share([*common, len(words) - sum(common)])))
    refs = {}
    for key in {m[1] for m in measured}:
        own = [m for m in measured if m[1] == key and len(m[0]) >= q.MIN_WORDS]
        if own:
            refs[key] = [np.mean([m[i] for m in own], axis=0) for i in (2, 3)]

    def far(p, r):
        p, r = np.array(p), np.array(r)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(2 * p / (p + r)), 0) + np.where(r > 0, r * np.log2(2 * r / (p + r)), 0)
        return np.sqrt(max(terms.sum() / 2, 0))

    kept = []
    for d, (words, key, chars, common) in zip(docs, measured):
        n = len(words)
        windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
        times = Counter(windows)
        again = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
        if n < 20 or 100 * len(again) > 30 * n:
            continue
        if n >= q.MIN_WORDS and key in refs:
            c, w = refs[key]
            if far(chars, c) > q.MAX_CHAR_DISTANCE or far(common, w) > q.MAX_WORD_DISTANCE or (1 - w[-1] > 0 and (1 - common[-1]) / (1 - w[-1]) < q.LEAST_COMMON):
                continue
        kept.append(d)
    return kept


def brute_line_stage(docs):
    kept = brute_lines([(d["doc_id"], d["text"]) for d in docs])
    new = ["\n".join(kept[d["doc_id"]]) for d in docs]
    return [d if t == (d["text"] or "") else d | {"text": t, "n_chars": len(t)} for d, t in zip(docs, new)]


def brute_near(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    root = brute_components([d["text"] for d in docs], 5, 80, 100)
    return [d for i, d in enumerate(docs) if root[i][1] == i]


def brute_benchmark_free(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = {}
    for w in map(words, items):
        m = min(13, len(w))
        held.setdefault(m, set()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m)
    return [d for d in docs if not any(tuple(w[i : i + m]) in g for w in [words(d["text"])] for m, g in held.items() if m for i in range(len(w) - m + 1))]


def test_pipeline(spark, duck):
    """Every stage on all that the one before kept; what it keeps is what the plain version keeps."""
    items = [r[0] for r in duck.sql("SELECT text FROM benchmark").fetchall()]
    brute = {"quality rules": brute_quality, "line dedup": brute_line_stage, "near duplicates": brute_near, "decontamination": lambda d: brute_benchmark_free(d, items)}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, schema = frame.columns, frame.schema
    plain = lambda f: sorted((r.asDict() for r in f.collect()), key=lambda d: d["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = plain(frame)
        after = stage(spark, frame, SF)
        assert after.columns == columns
        found = plain(after)
        assert found == sorted(brute[name](before), key=lambda d: d["doc_id"]), name
        frame = spark.createDataFrame([tuple(d[c] for c in columns) for d in found], schema)
    library = Tokenizer.from_file(tokenizer_path())
    rows = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    texts = {d["doc_id"]: d["text"] or "" for d in found}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded_sha256 == sha256(decoded.encode()).hexdigest()


def test_stages_on_hard_rows(spark):
    """Null, empty and very long texts, null and repeated ids, extra columns of clashing names, and empty tables."""
    prose = "the of and to in a is that it for stone river window paper garden on by with as was be".split()
    rng = random.Random(5)
    good = " ".join(rng.choice(prose) for _ in range(80)) + "."
    rows = [(1, None), (2, ""), (3, "word " * 300_000), (4, good), (4, good), (None, good + " more"), (None, None), (6, " ".join(rng.choice(prose) for _ in range(90)) + ".")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, [2], "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int, keep_runs array<int>, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.schema.names == frame.schema.names, name
        left = out.collect()
        assert {r.doc_id for r in left} >= {4, 6} and (name == "quality rules" or len(left) >= 5) and all(r.keep_runs == [2] and r.kept == "x" for r in left), name
        assert stage(spark, frame.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, frame, SF).count() == 8 and last(spark, frame.limit(0), SF).count() == 0

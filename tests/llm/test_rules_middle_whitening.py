"""Quality rules, fill-in-middle and whitening against brute force, on small tables with nulls,
empty, repeated, very long and clashing inputs."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import fill_in_middle as fim
from linkloom.llm import line_rules, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
# Names of the operators' own columns come in as extra columns.
DOCS = ("doc_id long, text string, lang string, source string, n_words long, kept boolean, row long, words long, "
        "form string, output string, host string, salt long, n long")


def _words(rng, n, vocab=3000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def _texts():
    rng = random.Random(7)
    often = ["Accept all Cookies, please.", "Page 12 of 40", "page 7  of 39"]
    texts = [None, "", " \t\n", "\n\n", "one", "ÜBER straße 日本 \U0001f600", "a\x0bb\x1cc \x85 d", "# * $ | < > % & #",
             "<P> here", "x <M>", "<S", "P>", " ".join(_words(rng, 30_000)), "w " * 400, "a b c " * 30,
             "x\n" * 60, " ".join(_words(rng, 49)), " ".join(_words(rng, 50)), "\n".join(["same line of words"] * 40),
             " ".join(_words(rng, 3)) + "   ", "  " + " ".join(_words(rng, 4)) + "\n"]
    for _ in range(60):
        lines = [" ".join(_words(rng, rng.randint(4, 20))) for _ in range(rng.randint(4, 9))]
        lines.insert(rng.randrange(len(lines)), rng.choice(often))
        texts.append("\n".join(lines))
    texts += [texts[-1]] * 30                               # copies of one document
    short = [" ".join(_words(rng, 8)) for _ in range(9)]    # documents made of shared lines, with few own words
    for _ in range(12):
        texts.append("\n".join([*short, " ".join(_words(rng, 8))]))
    return texts


TEXTS = _texts()


def _docs(spark, rows=None):
    rows = rows if rows is not None else [(i, t, "s%d" % (i % 2) if i % 9 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([(i, t, "en", s, 5, True, 3, 4, "spm", "<P>", "h", 1, 2) for i, t, s in rows], DOCS) \
        .repartition(4)


ODD = [(None, "a b c d e f", None), (1, None, None), (2, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "other", "s")]


# ---- quality rules ----------------------------------------------------------

def _rules(rows, least_docs, percent_docs, least_words=50, percent_left=50):
    def norm(line):
        return re.sub("[1-9]", "0", " ".join(WORD.findall(line)).translate({c: c + 32 for c in range(65, 91)}))

    hosts, held = {}, {}
    for _, text, host in rows:
        text, host = text or "", host or ""
        hosts.setdefault(host, set()).add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                held.setdefault((host, norm(line)), set()).add(text)
    out = []
    for doc_id, text, host in rows:
        text, host = text or "", host or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)}
        lines = [s for s in text.split("\n") if WORD.search(s)]
        over = [s for s in lines if len(held[host, norm(s)]) >= least_docs
                and 100 * len(held[host, norm(s)]) > percent_docs * len(hosts[host])]
        left = len(words) - sum(len(WORD.findall(s)) for s in over)
        failed = len(words) < least_words or 100 * len(repeat) > 50 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(repeat), failed,
                    not failed and left >= least_words and 100 * left >= percent_left * len(words), len(over), left))
    return out


COLUMNS = ["doc_id", *line_rules.MEASURES, "base_failed", "kept", "n_lines_removed", "n_words_left"]


@pytest.mark.parametrize("least,percent", [(20, 1), (5, 10), (3, 60)])
def test_quality_rules(spark, least, percent):
    rows = [(i, t, "s%d" % (i % 2) if i % 9 else None) for i, t in enumerate(TEXTS)]
    got = line_rules.quality_rules(_docs(spark, rows), least_docs=least, percent_docs=percent)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(_rules(rows, least, percent))


def test_quality_rules_verdicts_differ():
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    out = _rules(rows, 5, 10)
    copies = {i for i, t in enumerate(TEXTS) if TEXTS.count(t) > 20}
    kept = {r[0] for r in out if r[7]}
    assert copies <= kept                                    # copies alone make no boilerplate
    depleted = {r[0] for r in out if not r[6] and not r[7]}
    assert set(range(len(TEXTS) - 12, len(TEXTS))) <= depleted and len(depleted) < 20
    assert any(r[8] and r[7] for r in out)


def test_quality_rules_equal_sql(spark):
    rows = [(i, t, "s%d" % (i % 2) if i % 9 else None) for i, t in enumerate(TEXTS)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    names = [c for c in COLUMNS]
    want = db.sql(f"SELECT {', '.join(names)} FROM ({line_rules.ORACLE_SQL})").fetchall()
    assert sorted(want) == sorted(map(tuple, line_rules.quality_rules(_docs(spark, rows)).select(*names).collect()))


def test_rules_applied(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    docs = _docs(spark, rows)
    out = line_rules.apply_rules(docs, least_docs=5, percent_docs=10)
    assert out.columns == docs.columns
    want = {r[0]: r[8:] for r in _rules(rows, 5, 10) if r[7]}
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == set(want)
    for i, (gone, left) in want.items():
        assert len(WORD.findall(got[i])) == left
        assert got[i] == TEXTS[i] if not gone else "Cookies" not in got[i] and len(got[i].split("\n")) == \
            len(TEXTS[i].split("\n")) - gone


# ---- fill in the middle -----------------------------------------------------

def _fim(doc_id, text):
    text = text or ""
    tokens, digest = TOKEN.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    docs = _docs(spark)
    made = fim.fill_in_middle(docs)
    want = {i: _fim(i, t) for i, t in enumerate(TEXTS)}
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == want
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    assert {r.doc_id: r.restored for r in fim.restored(made).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in fim.round_trip(docs).collect():
        assert r.output_sha256 == hashlib.sha256(want[r.doc_id][4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_rotations_restore_every_cut():
    rng = random.Random(3)
    for _ in range(300):
        text = bytes(rng.choice(b"<>PSMab \n") for _ in range(rng.randint(0, 14)))
        if any(s in text for s in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
            continue
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        for form in ("psm", "spm"):
            out = bytes(fim.arrange(text, a, b, form))
            parts = {"<P>": text[:a], "<M>": text[a:b], "<S>": text[b:]}
            order = ("<P>", "<S>", "<M>") if form == "psm" else ("<S>", "<P>", "<M>")
            assert out == b"".join(k.encode() + parts[k] for k in order)
            assert fim.restore(out, form) == text


def test_fill_in_middle_odd_and_empty(spark):
    rows = fim.round_trip(_docs(spark, ODD)).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 1
    same = [tuple(r) for r in rows if r.doc_id == 2 and r.n == 6]
    assert len(same) == 2 and same[0] == same[1]
    assert fim.round_trip(_docs(spark, ODD).limit(0)).count() == 0
    raw = spark.sql("SELECT 4L AS doc_id, CAST(X'61ff2062' AS STRING) AS text")       # no valid UTF-8
    assert fim.round_trip(raw).first().restored_sha256 == hashlib.sha256(b"a\xff b").hexdigest()


def test_fill_in_middle_equals_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({fim.ORACLE_SQL})").fetchall()
    got = [tuple(r[c] for c in cols) for r in fim.round_trip(_docs(spark)).collect()]
    assert sorted(got) == sorted(want)


# ---- whitening --------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, deviation long, x binary, d int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, b"x", 3) for i, v in rows], VECTORS).repartition(3)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for rows, d, bits in ((1, 1, 1), (5, 3, 7), (64, 4, 20), (130, 5, 30), (200, 3, 61)):
        u = rng.integers(0, 1 << bits, (rows, d)).astype(np.uint64)
        u[:, 0] = 0
        got = whitening.scatter(u)
        big = u.astype(object)
        for i in range(d):
            assert got[i, d] == sum(big[:, i])
            assert [got[i, j] for j in range(i, d)] == [sum(big[:, i] * big[:, j]) for j in range(i, d)]


def test_packed_vectors_are_equal_only_for_equal_vectors():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-m, m + 1, 5) for m in (1, 100, 127, 128, 40_000, 1 << 40) for _ in range(40)]
    assert len({whitening.pack(r) for r in rows}) == len({tuple(r) for r in rows})
    column = whitening.pa.array([whitening.pack(r) for r in rows])
    assert (whitening.unpack(column, 5) == np.array(rows)).all()


def test_whitening(spark):
    rng, d = np.random.default_rng(4), 20
    base = rng.normal(0, 0.3, (300, d)) @ np.diag(np.linspace(2, 0.3, d))
    vectors = base.astype(np.float32).tolist()
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [], [1.0, 2.0]]
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(200)] + [(None, vectors[3])] \
        + [(2000 + i, v) for i, v in enumerate(bad)]
    out = whitening.whiten(_vectors(spark, rows)).collect()
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    fit = sorted({tuple(map(int, v)) for v in x})
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n)) for j in range(d)]
                    for i in range(d)])
    e, vecs = np.linalg.eigh(cov)
    e, vecs = e[::-1], vecs[:, ::-1]
    assert len(out) == 501 * 16 and {r.n for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert 3 in got and None in got and not any(2000 + i in got for i in range(6))
    mean = np.array(sums) / n
    for i in (0, 7, 299, 1005):
        v = x[7 if i >= 1000 else i]
        assert got[i][1].deviation == sum((n * int(c) - s) ** 2 for c, s in zip(v, sums))
        for k in range(16):
            want = float((v - mean) @ vecs[:, k] / np.sqrt(e[k]))
            assert abs(abs(got[i][k + 1].whitened) - abs(want)) < 1e-9 * max(1, abs(want))
    for k in range(16):
        assert abs(got[0][k + 1].explained - e[k] / e.sum()) < 1e-12
    assert 0 <= out[0].identity_error < 1e-9
    w = np.array([[got[fit_id][k + 1].whitened for k in range(16)] for fit_id in range(300)])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-6 if n == 300 else True


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(_vectors(spark, []).limit(0)).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(_vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == \
        {(1, 0, None, 0.0, None)}
    flat = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)])).collect()
    assert len(flat) == 18 and {r.component for r in flat if r.whitened is None} == {2, 3}
    assert all(r.identity_error < 1e-9 for r in flat)
    far = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 5e9])]
    rows = whitening.whiten(_vectors(spark, far)).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4} and any(r.deviation is None for r in rows)
    mixed = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [1.0, 2.0, 3.0])])).collect()
    assert {r.vec_id for r in mixed} == {1, 2}               # two vectors have length 2, one has 3


def test_whitening_does_not_depend_on_partitions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (sorted((r.vec_id, r.component, abs(r.whitened), r.deviation) for r in whitening.whiten(v).collect())
            for v in (vectors.coalesce(1), vectors.repartition(7)))
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert max(abs(x[2] - y[2]) for x, y in zip(a, b)) < 1e-9


@pytest.mark.parametrize("run", [line_rules.quality_rules, line_rules.apply_rules, fim.fill_in_middle])
def test_odd_and_empty_tables(spark, run):
    assert run(_docs(spark, ODD).limit(0)).count() == 0
    rows = run(_docs(spark, ODD)).collect()
    assert len(rows) == (0 if run is line_rules.apply_rules else 5)
    assert run(_docs(spark, ODD).withColumn("text", F.lit(None).cast("string"))).count() in (0, 5)

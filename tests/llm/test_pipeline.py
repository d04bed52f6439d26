import corpus_pipeline
from tests.conftest import SF, rows_of

from tidemill.llm import langid, ngram_join, queries


def test_oracles(spark, duck):
    for name, sql in queries.oracles().items():
        df, want = queries.QUERIES[name](spark, SF), duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.select(*names).collect()) == rows_of(want.fetchall()), name


def test_stages_equal_brute_force(spark):
    """Each stage on what the one before kept, against plain Python; the packed ids are all there."""
    from tests.llm.test_dedup_ops import components, low

    docs = queries.table(spark, SF, "documents")
    columns, now = docs.columns, docs
    model = langid.learn(docs)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        after = stage(spark, now, SF)
        ids = {r.doc_id for r in after.collect()}
        if name == "language id":
            bad = langid.predict(model, [(t or "").encode() for _, t in before])[2]
            assert ids == {i for (i, _), b in zip(before, bad, strict=True) if not b}
        elif name == "exact dedup":
            last = {}
            for i, t in before:
                last[low(t)] = max(i, last.get(low(t), i))
            assert ids == set(last.values())
        elif name == "n-gram join":
            assert ids == set(components(before).values())
        elif name == "decontamination":
            assert ids < {i for i, _ in before}
        else:
            assert ids == {i for i, _ in before}
            continue
        assert after.columns == columns
        now = spark.createDataFrame(after.collect(), docs.schema)


def test_stages_with_repeated_and_null_ids(spark):
    """Rows are told apart by id and text; of repeats one stays."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    near_a = a + " more"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = [(5, a), (7, a.upper()), (5, b), (None, b), (None, c), (None, c), (8, d), (8, d), (8, d.upper()), (None, None), (9, "")]
    for docs in (rows, rows * 3):
        got = of(corpus_pipeline.exact(spark, frame([(*r, "x") for r in docs]), SF))
        assert [(i, (t or "").lower()) for i, t in got] == sorted([(7, a), (5, b), (None, c), (8, d), (9, "")], key=str)
    rows = [(5, near_a), (4, a), (5, b), (None, b), (None, c), (None, c), (None, c + " more"), (8, d), (8, d), (8, d + " more")]
    for docs in (rows, rows * 3):
        kept = corpus_pipeline.near(spark, frame([(*r, "x") for r in docs]), SF)
        got = of(kept)
        assert kept.columns == ["doc_id", "text", "lang"] and len(got) == 4
        assert [(i, t[0]) for i, t in got] == sorted([(4, "a"), (5, "b"), (None, "c"), (8, "d")], key=str)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.length for r in rows) <= 4096 and corpus_pipeline.ORACLE_SQL is None


def test_ngram_join_equals_sql(spark, duck):
    """Brute force in SQL, on the smallest tables only: it compares all pairs."""
    got = queries.op10_ngram_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert rows_of(got) == rows_of(duck.execute(ngram_join.ORACLE_SMALL).fetchall())

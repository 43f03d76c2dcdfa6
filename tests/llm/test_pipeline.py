import corpus_pipeline
from ledgerline.llm import registry

SF = "/root/testdata/sf0.001"


def test_registry():
    assert {int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in registry.queries()


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("text RLIKE '[a-z0-9]@mail'").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == before


def test_stages_with_null_ids_and_any_columns(spark):
    """Each filtering stage on rows without ids, with columns of any name, and on no rows."""
    from pyspark.sql import functions as F

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"word{i}x" for i in range(60))
    rows = [(None, long, "a"), (None, long, "b"), (1, long + " more", "c"), (2, bench, "d"), (None, bench, "e"), (3, None, "f"), (4, "", "g"), (5, "mail jo.doe@mail.example.com now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("source", "n_chars", "kept_id", "bad_id", "node", "version", "row", "same_id", "id", "no_id", "spans")})
    stages = dict(corpus_pipeline.STAGES)
    left = {name: stages[name](spark, docs, SF) for name in ("quality_classifier", "jaccard_join", "decontamination", "pii")}
    assert all(x.columns == docs.columns for x in left.values())
    joined = [r.lang for r in left["jaccard_join"].collect()]
    assert "c" in joined and not {"a", "b"} & set(joined) and {"d", "f", "g", "h"} <= set(joined) and "e" not in joined
    assert sorted(r.lang for r in left["decontamination"].collect()) == ["a", "b", "c", "f", "g", "h"]
    assert {r.lang: r.text for r in left["pii"].collect()}["h"] == "mail [EMAIL] now"
    assert all(stages[name](spark, docs.limit(0), SF).count() == 0 for name in stages)


def test_the_driver_plans_small_steps_and_loops_without_collecting_garbage(spark):
    """The driver was stopped in decontamination. A JVM told to collect in each round of a loop grows its heap to its limit."""
    from ledgerline.llm import leaks
    from ledgerline.llm.components import components

    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in beans)
    links = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0 if i < 10 else 10) for i in range(21)}
    assert beans and sum(b.getCollectionCount() for b in beans) == before
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = leaks.clean(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan

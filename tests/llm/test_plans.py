"""What operators do once only."""

import contextlib
import io

from pixelframe.llm import suffix_dedup


def test_suffix_dedup_makes_and_deals_anchors_once(spark, monkeypatch):
    plans, cut = [], suffix_dedup.cut

    def spy(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.append((df.columns, out.getvalue()))
        return cut(df)

    monkeypatch.setattr(suffix_dedup, "cut", spy)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows what is reused
    try:
        passage = "a passage of more than fifty bytes, which both documents have "
        docs = spark.createDataFrame([(1, passage + "one"), (2, "two " + passage), (3, "three")], "doc_id long, text string")
        removed = {r.doc_id: r.n_removed for r in suffix_dedup.find_repeats(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert removed == {1: 0, 2: len(passage), 3: 0}
    (plan,) = [text for columns, text in plans if "piece" in columns and "start" in columns]
    assert plan.count("ArrowEvalPython") == 1

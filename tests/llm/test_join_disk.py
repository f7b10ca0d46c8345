"""What the Jaccard join shuffles for meeting and ranking."""

import numpy as np
import pytest

from larder.llm import jaccard_join
from larder.llm.jaccard_join import Rule


class Stopped(Exception):
    pass


@pytest.mark.parametrize("rule", [Rule(), Rule(n=5, num=80, den=100)])
def test_postings_are_shuffled_once(spark, monkeypatch, rule):
    found = []

    def stop(edges):
        found.append((edges._jdf.queryExecution().executedPlan().toString(), edges.count()))
        raise Stopped

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text if i < 6 else f"{text} x{i}") for i in range(8)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "components", stop)
    with pytest.raises(Stopped):
        jaccard_join.similar_components(docs.repartition(2), rule)
    text, edges = found[0]
    assert text.count("Exchange hashpartitioning(key") == 1 and "hashpartitioning(key#" in text
    assert "sig#" not in text[text.index("hashpartitioning(key#"):].split("]")[0].split(")")[0]
    assert edges > 0


def test_ranks_do_not_depend_on_the_tasks(spark):
    rule = Rule(n=5, num=80, den=100)
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 97}" for j in range(80)),) for i in range(60)], "text string")
    one = jaccard_join._shingle_ranks(docs.coalesce(1), rule, 3000)
    assert np.array_equal(one, jaccard_join._shingle_ranks(docs.repartition(50), rule, 3000)) and one.any()

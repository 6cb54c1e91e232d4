import random

import pytest
from pyspark.sql import functions as F

from mishear.llm import ngram_join
from mishear.llm._cluster import checkpointed
from mishear.llm._components import components
from tests.llm.test_llm import ODD, brute_links, passages


def brute(rows):
    """(id, class, copy, links) of each row; rows are the vertices."""
    links = brute_links([t for _, t in rows])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    words = [(t or "").split() for _, t in rows]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    out = []
    for k, (i, _) in enumerate(rows):
        own = [rows[m][0] for m, v in links.items() if v[0] == links[k][0]]
        same = [rows[m][0] for m in range(len(rows)) if sets[m] == sets[k]]
        out.append((i, least(own), least(same), links[k][1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("docs,blocks", [(256, 32), (4, 3), (2, 32)])
def test_ids_that_are_null_or_repeat(spark, monkeypatch, docs, blocks):
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", docs)
    monkeypatch.setattr(ngram_join, "CORE_BLOCKS", blocks)
    r = random.Random(docs)
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten")
    tail = [" ".join(x.split() * 3) for x in (a, b)]
    rows = [(1, tail[0]), (1, tail[1]), (2, tail[0] + " end"), (3, tail[1] + " end"), (None, tail[0] + " stop"), (None, b), (None, None), (4, "")]
    base = [r.choice("abcdefgh") * 3 + str(k) for k in range(60)]
    for k in range(24):  # a dense group of near copies
        own = list(base)
        own[r.randrange(60)] = f"other{k}"
        rows.append((r.choice([None, 7, 100 + k]), " ".join(own)))
    rows += [(r.choice([None, *range(20)]), t) for t in passages(docs, 20) + ODD[:4] + ODD[6:9]] + [(None, tail[0])] * 9 + [(5, a)] * 5
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((x.doc_id, x.class_id, x.copy_id, x.n_links) for x in ngram_join.join(frame).collect()), key=str)
    assert got == brute(rows)


def test_estimates_of_size_do_not_grow_from_step_to_step(spark):
    def bits(df):
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()

    step = spark.range(20).withColumnRenamed("id", "a")
    for _ in range(9):
        step = checkpointed(step.join(step.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a").distinct())
    assert bits(step) < 70 and sorted(r.a for r in step.collect()) == list(range(20))
    order = random.Random(3).sample(range(3000), 3000)  # a long path takes many rounds
    roots = components(spark.createDataFrame(list(zip(order, order[1:])), "u long, v long"))
    assert bits(roots) < 400 and roots.where("root <> 0").count() == 0 and roots.count() == 3000

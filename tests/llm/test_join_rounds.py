"""Rounds of the Jaccard join cost what they verify: lists are gone through once, texts are not shuffled."""

from tillhouse.llm.jaccard_join import jaccard_join
from tillhouse.llm.workspace import Workspace


def _jaccard(a: str, b: str) -> float:
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_a_further_round_does_not_go_through_the_lists(spark, monkeypatch):
    """Each text of a chain differs from the next by one word in another place, so links come in rounds."""
    words, texts = [f"w{i}" for i in range(100)], []
    for n in range(12):
        words = [*words[: 8 * n], f"new{n}", *words[8 * n + 1 :]]
        texts.append(" ".join(words))
    texts += [" ".join(f"x{n}y{i}" for i in range(60)) for n in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    names, save = [], Workspace.save

    def named(self, df, name):
        names.append(name)
        return save(self, df, name)

    monkeypatch.setattr(Workspace, "save", named)
    found = {r.doc_id: r.component_id for r in jaccard_join(docs).collect()}
    assert found == {n: 0 if n < 12 else n for n in range(17)}
    assert all(_jaccard(texts[n], texts[n + 1]) >= 0.8 for n in range(11)) and _jaccard(texts[0], texts[11]) < 0.8
    assert sum(name.startswith("stars") for name in names) > 1
    assert sum(name.startswith(("members", "hubs", "met")) for name in names) == 2


def test_only_the_other_side_of_buckets_is_shuffled(spark, tmp_path):
    work = Workspace(spark, "buckets")
    work.root = str(tmp_path)
    bodies = work.save_buckets(spark.range(50).selectExpr("id", "id * 2 AS body"), "bodies", "id")
    pairs = work.save(spark.range(10).selectExpr("id * 5 AS id", "id AS other"), "pairs")
    both = pairs.hint("merge").join(bodies, "id")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.id: r.body for r in both.collect()} == {n * 5: n * 10 for n in range(10)}
    work.drop("bodies")
    assert not (tmp_path / "bodies").exists()

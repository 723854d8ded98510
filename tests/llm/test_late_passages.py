"""Passages that many documents share behind what is their own."""

from tillhouse.llm.jaccard_join import jaccard_join
from tillhouse.llm.workspace import Workspace


def test_a_passage_shared_late_makes_no_pairs(spark, monkeypatch):
    """Sixteen hundredths of each document are its own, the rest is common to all: too little to link, and
    no two of them meet early in their prefixes. A near copy among them is found."""
    common = [f"c{i}" for i in range(250)]
    texts = [[f"d{n}w{i}" for i in range(46)] + common for n in range(20)]
    texts.append([*texts[7][:-2], "other", "end"])
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id LONG, text STRING")
    rows, save = {}, Workspace.save

    def counted(self, df, name):
        saved = save(self, df, name)
        rows[name] = saved.count()
        return saved

    monkeypatch.setattr(Workspace, "save", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join(docs).collect()}
    assert found == {**{n: n for n in range(20)}, 20: 7}
    assert rows["signed"] > 0 and rows["near"] == 0

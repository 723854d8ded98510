"""Links between blocks of vectors, and the disk that they take."""

import numpy as np
import pytest

from tillhouse.llm import workspace
from tillhouse.llm.embedding_dedup import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _vectors():
    """Spread evenly, with copies, near copies at every angle and a crowd that is larger than a block."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(700, 12))
    near = base[100:700] + rng.normal(size=(600, 12)) * rng.uniform(0.05, 0.5, size=(600, 1))
    crowd = base[:1] + rng.normal(size=(250, 12)) * 0.05
    return np.concatenate([base, near, crowd, base[300:340], base[300:310]]).astype("f4")


@pytest.fixture(scope="module")
def rows():
    return [(i * 7 % 1_601, v.tolist(), 2 if i < 150 else 1) for i, v in enumerate(_vectors())]


@pytest.fixture(scope="module")
def linked(rows):
    """Ids that each id links with."""
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([i for i, *_ in rows]), np.array([g for *_, g in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return {int(i): set(ids[n].tolist()) for i, n in zip(ids, near, strict=True)}


def _components(linked):
    least = {i: i for i in linked}
    while (new := {i: min([least[i], *(least[j] for j in others)]) for i, others in linked.items()}) != least:
        least = new
    return least


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block_bytes", [3_000, 20_000])
def test_blocks_find_every_link(spark, rows, linked, kind, block_bytes):
    df = spark.createDataFrame(rows, SCHEMA.replace("float", kind)).repartition(3)
    found = {r.vec_id: r for r in embedding_dedup(df, cell_rows=40, block_bytes=block_bytes).collect()}
    assert {i: r.n_links for i, r in found.items()} == {i: len(others) for i, others in linked.items()}
    assert {i: r.component_id for i, r in found.items()} == _components(linked)
    assert sum(r.kept for r in found.values()) == len(set(_components(linked).values()))


@pytest.mark.parametrize("block_bytes", [3_000, 1 << 20])
def test_probes_bound_the_visits(spark, rows, linked, block_bytes):
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {}
    for probes in (1, 1_000):
        got = embedding_dedup(df, cell_rows=20, block_bytes=block_bytes, probes=probes).collect()
        counts[probes] = {r.vec_id: r.n_links for r in got}
    assert counts[1_000] == {i: len(others) for i, others in linked.items()}
    assert all(n <= counts[1_000][i] for i, n in counts[1].items())
    assert 0 < sum(counts[1].values()) < sum(counts[1_000].values())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 150_000}])
def test_disk_follows_the_vectors(spark, tmp_path, monkeypatch, options):
    """Vectors that are spread evenly come near to most cells, of which there are 60."""
    x = np.random.default_rng(5).normal(size=(6_000, 32)).astype("f4")
    source = f"{tmp_path}/embeddings.parquet"
    data = [(i, v, 1) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(data, SCHEMA).write.parquet(source)
    given = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getPath(): f.length() for f in map(store.getAllFiles().apply, range(store.getAllFiles().size()))}
    before, used = set(shuffled()), []
    save = workspace.Workspace.save

    def measured(work, *args, **kwargs):
        table = save(work, *args, **kwargs)
        files = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*") if p.is_file())
        used.append(files + sum(size for path, size in shuffled().items() if path not in before))
        return table

    monkeypatch.setattr(workspace.Workspace, "save", measured)
    monkeypatch.setattr(workspace, "shared_dir", lambda spark, purpose: f"{tmp_path}/shared/{purpose}")
    assert embedding_dedup(spark.read.parquet(source), cell_rows=100, **options).count() == len(data)
    assert max(used) < 4 * given

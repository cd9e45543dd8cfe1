"""Vectors that are kept by content."""

from siltstone.engine import Engine, Settings
from siltstone.operators import embedding
from siltstone.operators.embedding_store import KEPT, EmbeddingStore
from tests.test_engine import Picky, write


class Silent(embedding.HashingProvider):
    """Embeds nothing: whatever gets a vector had it before."""

    def embed(self, texts):
        raise RuntimeError("asked")


def test_a_second_workspace_of_equal_files_embeds_nothing(spark, tmp_path):
    files = {f"d/f{k}.md": f"# Title {k}\ntext {k}\n" for k in range(12)}
    write(tmp_path / "one", files)
    write(tmp_path / "two", files | {"new.md": "# New\nother\n"})
    first = Engine(spark, f"{tmp_path}/store", Picky()).index_workspace(str(tmp_path / "one"))
    e = Engine(spark, f"{tmp_path}/store", Silent(8))
    second = e.index_workspace(str(tmp_path / "two"))
    assert second.chunks_indexed == first.chunks_indexed == 12 and second.warnings == ["asked"]
    vectors = lambda name: sorted((r.content, r.embedding) for r in e.vectors.read(name).collect())
    assert vectors(first.collection_name) == vectors(second.collection_name)
    # another model has vectors of its own, and so has who keeps none
    assert Engine(spark, f"{tmp_path}/store", Silent(4)).index_workspace(str(tmp_path / "two"), force=True).chunks_indexed == 0
    assert Engine(spark, f"{tmp_path}/other", Silent(8), Settings(keep_embeddings=False)).index_workspace(str(tmp_path / "one")).chunks_indexed == 0


def test_rows_are_kept_once(spark, tmp_path):
    s = EmbeddingStore(spark, f"{tmp_path}/e", "m", 2)
    rows = lambda *names: spark.createDataFrame([(n, [float(len(n)), 1.0] if n != "none" else None) for n in names], KEPT)
    s.add(rows("a", "b", "a", "none"))
    s.add(rows("b", "ccc"))
    assert sorted(r.content_hash for r in s.kept().collect()) == ["a", "b", "ccc"]
    s.kept().write.parquet(f"{s.folder}/again")  # as if two runs had added the same
    assert sorted(r.content_hash for r in s.of(rows("a", "ccc", "x")).collect()) == ["a", "ccc"]
    s.compact()
    assert sorted(r.content_hash for r in s.kept().collect()) == ["a", "b", "ccc"] and len(s._folders()) == 1
    assert EmbeddingStore(spark, f"{tmp_path}/e", "m", 3).kept().isEmpty()

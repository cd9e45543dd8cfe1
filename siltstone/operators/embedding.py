"""Embedding: distinct content once, by a provider that runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from siltstone.functions import keys as K
from siltstone.functions.text import EMBED_CHARS

if TYPE_CHECKING:
    from siltstone.operators.embedding_store import EmbeddingStore


class Provider(Protocol):
    """Makes vectors of texts; a text that it cannot embed gives None."""

    name: str
    width: int

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class HashingProvider:
    """Deterministic unit vectors from hashed words, for use without a model."""

    def __init__(self, width: int = 64, name: str = "hashing"):
        self.width, self.name = width, name

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        import hashlib
        import math
        import re

        out: list[list[float] | None] = []
        for text in texts:
            v = [0.0] * self.width
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


class ModelCatalog:
    """Names of installed models, and the rule that picks one."""

    def __init__(self, entries: Sequence[dict[str, str | None]]):
        names = [(e.get("name") or e.get("model") or "").strip() for e in entries]
        self.names = sorted({n.lower(): n for n in reversed(names) if n}.values(), key=str.lower)

    def resolve(self, wanted: str, fallback: str | None = None, allow_fallback: bool = False) -> tuple[str, bool]:
        """(installed name, whether it is the fallback): equal to the wanted name or a tag of it."""
        for name, is_fallback in ((wanted, False), (fallback, True)):
            if name is None or (is_fallback and not allow_fallback):
                continue
            for installed in self.names:
                if installed.lower() == name.lower() or installed.lower().startswith(name.lower() + ":"):
                    return installed, is_fallback
        raise LookupError(f"model {wanted!r} is not installed; installed: {', '.join(self.names) or 'none'}")


def embedding_inputs(chunks: DataFrame, limit: int = EMBED_CHARS) -> DataFrame:
    """(content_hash, content, uses): each distinct content, cut to what the model takes."""
    return chunks.groupBy(K.embedding_key(F.col("content"), limit).alias("content_hash")).agg(
        F.min(F.substring("content", 1, limit)).alias("content"), F.count(F.lit(1)).alias("uses")
    )


def embedded(chunks: DataFrame, provider: Provider, batch: int = 16, limit: int = EMBED_CHARS, store: EmbeddingStore | None = None) -> DataFrame:
    """``chunks`` with ``embedding`` and ``embedding_error``; each distinct content is embedded once, and not if ``store`` has it.

    A batch that fails is tried again text by text; a text that fails alone keeps its message and no
    vector. The vectors go back to all chunks of the same content by a join on its hash.
    """

    def make(contents):
        import pandas as pd

        rows = []
        texts = contents.tolist()
        for at in range(0, len(texts), batch):
            some = texts[at : at + batch]
            try:
                rows += [(v, None) for v in provider.embed(some)]
            except Exception:  # noqa: BLE001  any provider's error
                for t in some:
                    try:
                        rows.append((provider.embed([t])[0], None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((None, str(e)))
        return pd.DataFrame({"embedding": [r[0] for r in rows], "embedding_error": [r[1] for r in rows]})

    shape = Ty.StructType([Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType())), Ty.StructField("embedding_error", Ty.StringType())])
    udf: Callable = F.pandas_udf(make, shape)
    inputs = embedding_inputs(chunks, limit)
    asked = inputs.join(store.of(inputs).select("content_hash"), "content_hash", "left_anti") if store else inputs
    once = asked.withColumn("made", udf(F.col("content"))).select("content_hash", "made.*")
    if store:
        once = once.unionByName(store.of(inputs).withColumn("embedding_error", F.lit(None).cast("string")))
    return chunks.withColumn("content_hash", K.embedding_key(F.col("content"), limit)).join(once, "content_hash").drop("content_hash")


def ready(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector."""
    return chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).drop("embedding_error")

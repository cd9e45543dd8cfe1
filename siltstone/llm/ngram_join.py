"""N-gram Jaccard join: connected components of documents whose shingle sets are alike.

1. *Document frequencies.* Each task sends its documents' shingle hashes in blocks of 32-bit
   fingerprints to the group that their hash names, with 64 bits of each set's signature. The group
   counts the different sets that hold each one and answers, once a set, for those that more than one
   set holds; a shingle of one set alone can't link anything and is sent once. There are as many groups
   as the texts' bytes need.
2. *Classes.* Documents with equal sets form a class; its smallest id stands for it from here on.
3. *Rare-first prefixes.* A set of n shingles, ordered by (frequency, fingerprint), links only with
   sets that share one of its first ``n - ceil(t n) + 1``. Shingles of frequency 1 come first and
   fill places there without an entry in the index. A fingerprint shared by two hashes may add a
   candidate, never lose one.
4. *Candidates.* Sets that share a prefix shingle meet in a bucket. Buckets of more than ``BLOCK``
   members are cut into blocks, and blocks meet in pairs; buckets with the same members are one.
   A pair stays if it passes the length filter, the positional filter (what the shared place leaves
   before and after it) and the suffix filter: what comes after the shared place is divided into
   ``CLASSES`` parts by fixed pivots among the hashes, the same for a whole bucket, and two
   suffixes have no more in common than the smaller of each part. Parity bitmaps of whole sets,
   which differ in at most as many bits as the sets differ in members, drop most of the rest.
5. *Verification* of each pair once, on the 64-bit hashes. The first round takes from each bucket a
   spanning forest of its likeliest pairs; after it, the second takes every pair that the filters
   leave between different components and that was not verified before. Pairs inside a component
   need no check, so a large group of near copies never becomes all of its pairs, and no link
   between components is lost. ``count_links`` verifies all pairs instead and counts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.scratch import Scratch
from siltstone.llm.shingles import bitmap, release, set_signature, shingle_set

if TYPE_CHECKING:
    import pyarrow as pa

NGRAM = 4
PERCENT = 85
BLOCK = 1024
BITS = 2048
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 60_000  # places in a chunk have 16 bits
#: Text behind a group of fingerprints, which a task holds at once, and behind a task of groups.
GROUP_BYTES = 4 << 20
TASK_BYTES = 8 << 20
MOST_TASKS = 20_000
#: Sets whose prefixes a task has in hand at once, an Arrow batch.
INDEX_SETS = 250
#: Parts of a suffix, a power of two.
CLASSES = 8
#: Ids of this many sets are broadcast (8 bytes each) to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
LISTS_IN_BATCH = 64

ASKED = "p int, fps binary, counts binary, ids binary, sigs binary"
ANSWERED = "doc_id long, n int, sig binary, low long, tok long, df int"
INDEXED = "tok long, rep long, n int, pos int, tail binary"


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows, for rows that hold whole buckets or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _chunks(batches: Iterator[pa.RecordBatch], ngram: int):
    """(ids, sets) of documents, about CHUNK_BYTES characters of text at a time."""
    ids, sets, held = [], [], 0
    batch = texts = text = None
    for batch in batches:
        texts = batch.column(1)
        for k, i in enumerate(batch.column(0).to_pylist()):
            text = texts[k].as_py()
            ids.append(i)
            sets.append(shingle_set(text, ngram))
            held += len(text or "")
            if held >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets
    del ids, sets, batch, texts, text
    release()


def _ask(ngram: int, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("p", pa.int32()), *((c, pa.binary()) for c in ("fps", "counts", "ids", "sigs"))])
        for ids, sets in _chunks(batches, ngram):
            rows = []
            signs = [set_signature(s) for s in sets]
            ids = np.array(ids, dtype=np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            # what the documents are, under negative numbers
            rows.append((-1 - int(ids[0]) % parts, sizes.astype("<u4").tobytes(), b"", ids.tobytes(), b"".join(signs)))
            hashes = np.concatenate(sets)
            p = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            fps = hashes[order].astype(np.uint32)  # the low half
            owner = np.repeat(np.arange(len(ids)), sizes)[order]
            low = np.array([int.from_bytes(s[:8], "little") for s in signs], dtype=np.uint64)
            p = p[order]
            firsts = np.flatnonzero(np.diff(p, prepend=-1))  # of the groups that there are
            for a, b in pairwise([*firsts.tolist(), len(p)] if len(p) else []):
                here, counts = np.unique(owner[a:b], return_counts=True)  # fingerprints are in the order of their sets
                rows.append((int(p[a]), fps[a:b].tobytes(), counts.astype("<u4").tobytes(), b"", low[here].tobytes()))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            del rows, sets, hashes, order, fps, owner, p
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return ask


def _answer(key, asked):
    """Documents as they are; for a partition of fingerprints, those that several sets hold, once a set (the low half of its signature)."""
    import numpy as np
    import pyarrow as pa

    p = key[0].as_py()
    column = lambda c, t: [np.frombuffer(x, dtype=t) for x in asked.column(c).to_pylist()]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(ANSWERED.split(", "), types, strict=True)])
    if p < 0:
        signs = b"".join(asked.column("sigs").to_pylist())
        flat = np.concatenate(column("ids", np.int64))
        none = pa.nulls(len(flat), pa.int64())
        cut = [signs[i : i + 16] for i in range(0, len(signs), 16)]
        n = np.concatenate(column("fps", np.uint32)).astype(np.int32)
        low = np.frombuffer(signs, dtype="<i8")[::2]
        return pa.Table.from_arrays(
            [pa.array(flat), pa.array(n), pa.array(cut, pa.binary()), pa.array(low), none, none.cast(pa.int32())], schema=schema
        )
    fps = np.concatenate(column("fps", np.uint32))
    sig = np.repeat(np.concatenate(column("sigs", np.uint64)), np.concatenate(column("counts", "<u4")))
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    twin = np.zeros(len(fps), dtype=bool)
    twin[1:] = fps[1:] == fps[:-1]
    twin[:-1] |= twin[1:]
    fps, sig = fps[twin], sig[order[twin]]
    order = np.lexsort((sig, fps))
    fps, sig = fps[order], sig[order]
    new_fp = np.ones(len(fps), dtype=bool)
    new_fp[1:] = fps[1:] != fps[:-1]
    new_set = new_fp.copy()
    new_set[1:] |= sig[1:] != sig[:-1]
    group = np.cumsum(new_fp) - 1
    df = np.bincount(group, weights=new_set)[group].astype(np.int32) if len(fps) else np.empty(0, np.int32)
    keep = new_set & (df > 1)
    tok = (np.int64(p) << np.int64(32)) | fps[keep].astype(np.int64)
    n = int(keep.sum())
    return pa.Table.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(sig[keep].view(np.int64)), pa.array(tok), pa.array(df[keep])],
        schema=schema,
    )


def _index(percent: int):
    """Prefix entries of sets: token, place, and how much of each part comes after it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            ends = batch.column(2).offsets.to_numpy()
            entries = batch.column(2).values
            toks = entries.field(entries.type.get_field_index("tok")).to_numpy()
            for k, (rep, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                tok = toks[ends[k] : ends[k + 1]]
                alone = max(n - len(tok), 0)
                prefix = n - -(-n * percent // 100) + 1 - alone
                if prefix <= 0:
                    continue
                part = (tok >> 29) & (CLASSES - 1)
                seen = np.cumsum(part[:prefix, None] == np.arange(CLASSES), axis=0)
                tails = np.bincount(part, minlength=CLASSES) - seen
                some = tok[:prefix]
                new = {t: j for j, t in reversed(list(enumerate(some.tolist())))}  # equal tokens of two hashes: the first
                for t, j in new.items():
                    for column, value in zip(columns, (t, rep, n, alone + j, tails[j].astype("<u4").tobytes()), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            names = [c.split()[0] for c in INDEXED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return index


def _sets(ngram: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for ids, found in _chunks(batches, ngram):
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": pa.array(ids, pa.int64()),
                    "grams": pa.array([s.view("<i8") for s in found], pa.list_(pa.int64())),
                    "bits": pa.array([bitmap(s, BITS) for s in found], pa.binary()),
                }
            )

    return sets


def _pairs(percent: int, forest: bool):
    """Pairs of a bucket that pass the filters; with ``forest``, a spanning forest of the likeliest."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            field = lambda name: flat.field(flat.type.get_field_index(name))
            rep, n, pos, side, comp = (field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "pos", "side", "comp"))
            bits = np.frombuffer(b"".join(field("bits").to_pylist()), dtype=np.uint64).reshape(len(rep), BITS // 64)
            tail = np.frombuffer(b"".join(field("tail").to_pylist()), dtype=np.uint32).reshape(len(rep), CLASSES).astype(np.int64)
            ends = np.cumsum([0, *(len(x) for x in column)])
            out: list[tuple[int, int]] = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                out += _bucket_pairs(percent, forest, *(x[a:b] for x in (rep, n.astype(np.int64), pos.astype(np.int64), side, comp, bits, tail)))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())}
            )

    return pairs


def _bucket_pairs(percent: int, forest: bool, rep, n, pos, side, comp, bits, tail) -> list[tuple[int, int]]:
    import numpy as np

    first, second, apart = [], [], []
    for i in range(len(rep) - 1):
        m, q = n[i + 1 :], pos[i + 1 :]
        need = -(-percent * (n[i] + m) // (100 + percent))  # least common members of a link
        ok = (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)) & (comp[i + 1 :] != comp[i])
        ok &= np.minimum(pos[i], q) + 1 + np.minimum(n[i] - pos[i] - 1, m - q - 1) >= need
        ok &= (side[i] < 0) | (side[i + 1 :] != side[i])  # two blocks: only pairs across
        j = np.flatnonzero(ok)
        if len(j):
            # the suffix filter
            common = np.minimum(pos[i], q[j]) + 1 + np.minimum(tail[i + 1 + j], tail[i]).sum(axis=1)
            j = j[common >= need[j]]
        if len(j):
            d = np.bitwise_count(bits[i + 1 + j] ^ bits[i]).sum(axis=1)
            stay = d <= n[i] + m[j] - 2 * need[j]
            first.append(np.full(int(stay.sum()), i))
            second.append(i + 1 + j[stay])
            apart.append(d[stay])
    if not first:
        return []
    x, y = np.concatenate(first), np.concatenate(second)
    if not forest:
        return [(int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))) for i, j in zip(x, y, strict=True)]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, open_ = [], len(set(comp.tolist())) - 1
    for k in np.argsort(np.concatenate(apart), kind="stable"):
        i, j = int(x[k]), int(y[k])
        ci, cj = find(int(comp[i])), find(int(comp[j]))
        if ci != cj:
            root[ci] = cj
            out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
            open_ -= 1
            if not open_:
                break
    return out


def jaccard_components(
    docs: DataFrame,
    ngram: int = NGRAM,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_links: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), a row for each row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``ngram``-word
    shingles (A-Z lower-cased; a text with fewer words has one shingle of them all). ``class_id`` is
    the smallest id with the same set, ``component_id`` the smallest that links reach. A null or
    wordless text has an empty set and its own id for both. Rows with equal ids count as one
    document that holds all their sets. A row with a null id links with nothing and gets null ids.
    Only the id and text columns are used. An empty table gives no rows. With ``count_links`` there
    is also ``n_links``, to how many other classes the document's class links; this verifies all
    candidate pairs, so a group of m near copies with different texts costs up to m * m / 2.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    held = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-held // GROUP_BYTES)), (1 << 31) - 1)
    tasks = min(max(1, -(-held // TASK_BYTES)), MOST_TASKS)
    asked = named.mapInArrow(_ask(ngram, parts), ASKED).repartition(tasks, "p")
    answers = scratch.table(asked.groupBy("p").applyInArrow(_answer, ANSWERED), "answers")
    known = answers.filter("sig IS NOT NULL").select("doc_id", "n", "sig", "low")
    firsts = (F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"))
    classes = scratch.table(known.filter("n > 0").groupBy("sig").agg(*firsts), "classes")

    # rare-first prefixes
    shared = answers.filter("tok IS NOT NULL").groupBy("low").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    sets_in_order = shared.join(classes.select("rep", "n", "low"), "low").select("rep", "n", "toks")
    with small_batches(spark, INDEX_SETS):
        index = scratch.table(sets_in_order.mapInArrow(_index(percent), INDEXED), "index")
    sizes = index.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = (
        index.join(sizes.filter("size > 1").select("tok", "blocks"), "tok")
        .withColumn("own", own)
        # every block with itself, where members have no side, and with every other
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "tok",
            F.least("own", "other").alias("bi"),
            F.greatest("own", "other").alias("bj"),
            F.struct("rep", "n", "pos", "tail", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side")).alias("m"),
        )
    )
    lists = (
        met.groupBy("tok", "bi", "bj")
        .agg(F.sort_array(F.collect_list("m")).alias("ms"))
        .filter("size(ms) > 1")
        .groupBy(F.transform("ms", lambda m: F.struct(m["rep"], m["n"], m["side"])).alias("who"))
        .agg(F.min(F.struct("ms", F.struct("tok", "bi", "bj").alias("lid"))).alias("one"))
    )
    buckets = scratch.table(lists.select("one.lid", F.explode("one.ms").alias("m")).select("lid", "m.*"), "buckets")
    asked = scratch.table(buckets.select("rep").distinct(), "asked")
    near = F.broadcast if asked.count() <= BROADCAST_IDS else (lambda df: df)
    wanted = named.join(near(asked.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    sets = scratch.table(wanted.mapInArrow(_sets(ngram), "rep long, grams array<long>, bits binary").dropDuplicates(["rep", "grams"]), "sets")
    buckets = scratch.table(buckets.join(sets.filter("size(grams) > 0").select("rep", F.size("grams").alias("n"), "bits"), ["rep", "n"]), "members")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    with small_batches(spark, LISTS_IN_BATCH):
        for forest in (False,) if count_links else (True, False):
            here = buckets.withColumn("comp", F.col("rep"))
            if labels is not None:
                here = buckets.join(labels, buckets["rep"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "rep"))
            full = (
                here.groupBy("lid")
                .agg(F.collect_list(F.struct("rep", "n", "pos", "side", "comp", "bits", "tail")).alias("ms"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                .filter("lo < hi")
                .select("ms")
            )
            found = full.mapInArrow(_pairs(percent, forest), "a long, b long").distinct()
            if links is not None:  # pairs that failed before are not verified again
                found = found.join(verified, ["a", "b"], "left_anti")
            verified = found = scratch.table(found, f"pairs-{forest}")
            side = lambda name: sets.select(F.col("rep").alias(name), F.col("grams").alias(f"g{name}"))
            both = found.join(side("a"), "a").join(side("b"), "b")
            common = F.size(F.array_intersect("ga", "gb"))
            linked = both.filter(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select("a", "b")
            if links is not None:
                linked = linked.unionByName(links)
            links = scratch.table(linked.distinct(), f"links-{forest}")
            labels = connected_components(links, scratch, f"components-{forest}")

    assert labels is not None and links is not None
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "sig", "rep", F.coalesce("component", "rep").alias("component")
    )
    if count_links:
        of_class = of_class.join(ends, "rep", "left").fillna(0, ["n_links"])
    nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    empty = known.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"), F.col("doc_id").alias("component"), zero.alias("n_links"))
    full = known.filter("n > 0").join(of_class, "sig")
    names = {"doc_id": F.col("doc_id"), "n_shingles": F.col("n").cast("long"), "class_id": F.col("rep"), "component_id": F.col("component")}
    if count_links:
        names["n_links"] = F.col("n_links")
    count = lambda df: df.select(*[c.alias(k) for k, c in names.items()])
    unnamed = rows.filter("doc_id IS NULL").mapInArrow(_sets(ngram), "rep long, grams array<long>, bits binary")
    unnamed = unnamed.select(F.col("rep").alias("doc_id"), F.size("grams").alias("n"), nothing.alias("rep"), nothing.alias("component"), zero.alias("n_links"))
    return count(full).unionByName(count(empty)).unionByName(count(unnamed))

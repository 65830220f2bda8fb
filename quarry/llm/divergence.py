"""How far the sources of a language differ in their words, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bytewords import LOWER, utf8
from quarry.llm.common import small_batches, staged

#: Bytes that no term holds: ASCII but for letters.
APART = np.ones(256, bool)
APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Text is taken apart in pieces of so many bytes.
PART = 1 << 24
NAMES = ["lang", "term", "source", "n", "docs"]
#: A dense matrix of one chunk has so many numbers at most: 32 MiB.
CELLS = 1 << 22
#: Terms of a chunk at most.
WIDTH = 8192
SALTS = 16


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row, term) of every term of every whole text, A-Z lower-cased, some PART bytes at
    a time, cut where no term is cut."""
    data, at = utf8(column)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begin = 0
    while begin < len(data):
        end = min(begin + PART, len(data))
        while end < len(data) and not APART[data[end]] and not first[end]:
            end += 1
        part = LOWER[data[begin:end]]
        solid = ~APART[part]
        edge = first[begin + 1 : end]
        start, stop = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1] | edge
        stop[:-1] &= ~solid[1:] | edge
        starts = np.flatnonzero(start)
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(stop) + 1 - starts)]).astype(np.int32)
        terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part[solid].tobytes())])
        if len(starts):
            yield np.searchsorted(at, starts + begin, "right") - 1, terms
        begin = end


def rows_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, code, terms, n): the distinct terms of each row, as codes into terms, and how
    often each occurs there."""
    parts = []
    for row, terms in terms_of(column):
        coded = terms.dictionary_encode()
        pair, n = np.unique(row << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
        parts.append((pair >> 32, pair & 0xFFFFFFFF, coded.dictionary, n))
    if len(parts) == 1:
        return parts[0]
    # texts that go on in the next part
    whole = [pa.table({"row": row, "term": terms.take(pa.array(code)), "n": n}) for row, code, terms, n in parts]
    table = pa.concat_tables(whole).group_by(["row", "term"]).aggregate([("n", "sum")]) if whole else pa.table({"row": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "n_sum": pa.array([], pa.int64())})
    coded = table["term"].combine_chunks().dictionary_encode()
    return table["row"].to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary, table["n_sum"].to_numpy()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, source, n, docs): occurrences of each term in the group and rows of the
    group that hold it. Tasks send sums over their batches, not occurrences."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[_filled(c).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            row, code, terms, n = rows_terms(batch["text"])
            lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            pair = group[row] << 32 | code
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            key = pair[order][first]
            group, code = key >> 32, key & 0xFFFFFFFF
            sums = [np.add.reduceat(n[order], first), np.diff(first, append=len(order))] if len(first) else [first, first]
            columns = [lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), terms.take(pa.array(code)), source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))), *map(pa.array, sums)]
            held.append(pa.Table.from_arrays(columns, NAMES))
            size += len(first)
            if size >= 1 << 19:
                held = [summed(held)]
                if held[0].num_rows > 1 << 18:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
                size = sum(t.num_rows for t in held)
        if held:
            yield from summed(held).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, "lang string, term string, source string, n long, docs long").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def summed(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(NAMES[:3]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(NAMES)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) by long division to the base 1000, so that no
    product leaves 64 bits for totals up to 9 * 10^15."""
    out = np.zeros(np.broadcast(count, total).shape, np.int64)
    rest = count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for each occurring (lang, source) group.

    Terms are runs of letters and of bytes beyond ASCII, A-Z lower-cased; a language keeps
    those in at least least_docs of its rows. With N kept occurrences in a group and V
    kept terms of its language, a term that occurs c times has the share
    1 + floor(10^9 (c + 2) / (N + 2 V)). Part `pair`: value is the sum over kept terms of
    floor((p - q)^2 / (p + q)) between the group and the other source in item; all ranks.
    Part `term`: the same for one kept term of the group that is more frequent there than
    in the whole language; ranks to top. Ranks go by value, the highest first, then by
    item in UTF-8 order. A language without kept terms has pairs of value 0.

    Null text, language and source are ''. Each row counts as a document, also where rows
    repeat. Other columns are ignored, whatever their names. An empty table gives no rows.

    The kept terms are sorted over the cluster and dealt in chunks of neighbours; a term's
    number within its chunk keeps UTF-8 order. A chunk is one dense matrix of groups by
    terms of CELLS numbers at most (a column of all groups where a language has more than that), so no task holds a language's words whole, and nothing is broadcast.
    """
    counts = staged(term_counts(docs, lang_col, source_col, text_col), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = staged(kept.select("lang", "term"), "kept").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = staged(kept.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id()), "sorted")

    occurring = staged(docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source")).distinct(), "groups")
    sources = occurring.groupBy("lang").agg(F.count("*").alias("sources"))
    # the terms of a language that one sorted run holds are cut into chunks
    runs = kept.groupBy("lang", "run").agg(F.min("at").alias("first"), F.count("*").alias("terms"))
    runs = sources.join(runs, "lang", "left").withColumn("width", F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.expr(f"{CELLS} div sources"))).cast("long")).drop("sources")
    placed = kept.join(runs.drop("terms"), ["lang", "run"])
    placed = placed.select("lang", "term", "run", F.expr("(at - first) div width").alias("chunk"))

    coded = staged(counts.select("lang", "term", "source", "n").join(placed, ["lang", "term"]), "coded")
    held = coded.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = runs.groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = occurring.join(held, ["lang", "source"], "left").join(sizes, "lang").na.fill(0, ["n", "v"])
    # every chunk needs every group of its language; a language without terms has one empty
    # chunk. Salts deal a large language's chunks to many tasks
    chunks = runs.select("lang", F.coalesce("run", F.lit(-1)).alias("run"), F.explode(F.expr("sequence(0L, (coalesce(terms, 1) - 1) div width)")).alias("chunk"))
    chunks = chunks.withColumn("salt", F.pmod(F.hash("run", "chunk"), F.lit(SALTS)))
    heads = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(chunks, ["lang", "salt"])
    heads = heads.select("lang", "run", "chunk", "source", F.lit(None).cast("string").alias("term"), "n", "v")
    rows = heads.unionByName(coded.withColumn("v", F.lit(0).cast("long")))

    found = rows.groupBy("lang", "run", "chunk").applyInArrow(_compared(top), "lang string, source string, part string, item string, value long")
    values = staged(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "values")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = values.where("part = 'pair'").withColumn("rank", rank)
    return pairs.unionByName(values.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top))


def _compared(top: int):
    """A chunk's part of all pair sums, and each group's top terms in it."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(table["term"].is_null())
        body = table.filter(table["term"].is_valid())
        lang, names = table["lang"][0], head["source"].combine_chunks()
        # numbers of terms and of sources: places in the sorted arrays
        terms, sources = np.unique(encoded(body["term"])), np.unique(encoded(names))
        n = head["n"].to_numpy()[np.argsort(encoded(names))]
        v = head["v"][0].as_py()
        term, group = np.searchsorted(terms, encoded(body["term"])), np.searchsorted(sources, encoded(body["source"]))
        cells = group * len(terms) + term
        at = np.argsort(cells)
        count = np.zeros(len(sources) * len(terms), np.int64)
        if len(cells):
            # the counts of a cell lie side by side; bincount's doubles would round from 2^53 on
            size = np.bincount(cells, minlength=len(count))
            full = np.flatnonzero(size)
            count[full] = np.add.reduceat(body["n"].to_numpy()[at], (np.cumsum(size) - size)[full])
        count = count.reshape(len(sources), len(terms))
        shown = [s.decode() for s in sources.tolist()]
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

        def put(source: int, part: str, items: list[str], values: np.ndarray) -> None:
            out["source"] += [shown[source]] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values.tolist()

        if len(terms):
            p = shares(count + 2, (n + 2 * v)[:, None])
            q = shares(count.sum(axis=0) + 2, n.sum() + 2 * v)
        for i in range(len(sources)):
            value = np.array([apart(p[i], p[j]).sum() for j in range(len(sources))], np.int64) if len(terms) else np.zeros(len(sources), np.int64)
            others = np.flatnonzero(np.arange(len(sources)) != i)
            put(i, "pair", [shown[j] for j in others], value[others])
            if len(terms):
                own = np.flatnonzero((count[i] > 0) & (p[i] > q))
                f = apart(p[i][own], q[own])
                best = np.lexsort((own, -f))[:top]
                put(i, "term", [terms[k].decode() for k in own[best]], f[best])
        return pa.table({"lang": pa.array([lang.as_py()] * len(out["source"]), pa.string()), **{k: pa.array(x, pa.int64() if k == "value" else pa.string()) for k, x in out.items()}})

    return run


def encoded(column) -> np.ndarray:
    """Strings as bytes objects, which sort as their UTF-8 does."""
    return np.array([s.encode() for s in column.to_pylist()], object)


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counted AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n, v,
         sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p FROM cells),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 2)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 2 * any_value(v)) AS q
  FROM cells GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

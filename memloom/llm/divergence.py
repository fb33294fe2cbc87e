"""Source divergence audit: how far each source's words are from those of others, in exact whole numbers.

Terms that many sources of a language have are compared in dense tiles, terms by sources. Other
terms enter as if each source were compared with one that lacks the term, which depends on the
count alone, so that a histogram of counts is enough; what is wrong with that where two sources
share a term is put right for each pair in its postings. Both sums are added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, saved

#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 3
#: A term is heavy if one source in so many of its language, and more than one, have it.
HEAVY_SHARE = 3
#: Heavy terms of a dense tile, postings of a sparse one, sources of a block.
TILE_TERMS, TILE_POSTINGS, BLOCK = 512, 100_000, 256
#: Terms reported for each source.
TOP = 200
#: Bytes of distinct terms that a task counts before it hands counts on; beside its own, a term takes ``ENTRY_BYTES``.
COUNTED_BYTES, ENTRY_BYTES = 80 << 20, 130
SCALE = 1_000_000_000
_ONE, _LOW = 1 << 36, (1 << 36) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of some documents at a time; a document's terms are counted at once."""
    term = re.compile(rb"[a-z\x80-\xff]+")  # the UTF-8 bytes of all that is no separator
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences, and above them documents
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names, counts = pa.array(list(terms), pa.binary()).cast(pa.string()), np.fromiter(terms.values(), np.int64, len(terms))
            for begin in range(0, len(names), 50_000):
                some, own = names.slice(begin, 50_000), counts[begin : begin + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), some, pa.array(own & _LOW), pa.array(own >> 36)],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            group = held.setdefault((lang, source), {})
            known = len(group)
            # Bytes: A to Z alone are lowered.
            for t, n in Counter(term.findall((text.as_py() or "").encode().lower())).items():
                group[t] = group.get(t, 0) + n + _ONE
                size += len(t) if len(t) > 40 else 0
            size += ENTRY_BYTES * (len(group) - known)
            if size > COUNTED_BYTES:
                yield from out()
                size = 0
    yield from out()


def _share(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / total)``, by long division in three digits of a thousand so that nothing overflows."""
    rest, digits = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        digits = digits * 1000 + _div(rest * 1000, total)
        rest = (rest * 1000) % total
    return digits + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    rest, digits = n + 1, 0
    for _ in range(3):
        digits = digits * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return digits + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(g: np.ndarray, h: np.ndarray, value: np.ndarray, lang: str) -> pa.RecordBatch:
    """``lang, g, h, value``: sources by number, and what is to be added for the pair."""
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(h), pa.array(value)], ["lang", "g", "h", "value"]
    )


_PAIR = "lang string, g long, h long, value long"


def _dense(table: pa.Table) -> pa.Table:
    """A tile of heavy terms and two blocks of sources.

    Rows without a term state a source and its total, and as ``n`` how many terms the tile has: some may be in neither block.
    """
    lang = table["lang"][0].as_py()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    ids = table["id"].to_numpy()
    term = table["term"].combine_chunks().dictionary_encode().indices
    absent = np.asarray(term.is_null())
    term = term.fill_null(-1).to_numpy()
    heads = np.flatnonzero(absent)
    heads = heads[np.argsort(ids[heads], kind="stable")]
    sources, totals = ids[heads], table["total"].to_numpy()[heads]
    counts = np.zeros((int(term.max()) + 1, len(sources)), np.int64)
    counts[term[~absent], np.searchsorted(sources, ids[~absent])] = table["n"].to_numpy()[~absent]
    share = _shares(counts, totals[None, :])
    none, elsewhere = _shares(np.zeros_like(totals), totals), table["n"].to_numpy()[heads[0]] - len(counts)
    blocks = {b: np.flatnonzero(sources // BLOCK == b) for b in {low, high}}
    found = []
    for of, to in {(low, high), (high, low)}:
        p, q = share[:, blocks[of]], share[:, blocks[to]]
        value = elsewhere * _distance(none[blocks[of]][:, None], none[blocks[to]][None, :])
        step = max(1, (1 << 21) // max(1, value.size))
        for begin in range(0, len(p), step):
            value += _distance(p[begin : begin + step, :, None], q[begin : begin + step, None, :]).sum(axis=0)
        g, h = np.repeat(sources[blocks[of]], q.shape[1]), np.tile(sources[blocks[to]], p.shape[1])
        apart = g != h
        found.append(_pairs(g[apart], h[apart], value.ravel()[apart], lang))
    return pa.Table.from_batches(found)


def _sparse(table: pa.Table) -> pa.Table:
    """Corrections for the pairs of sources in each posting list of a tile of light terms."""
    lang = table["lang"][0].as_py()
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, ids = term[order], table["id"].to_numpy()[order]
    total, n = table["total"].to_numpy()[order], table["n"].to_numpy()[order]
    share, none = _shares(n, total), _shares(np.zeros_like(n), total)
    first = np.searchsorted(term, term)  # where each row's list begins, and how long it is
    length = np.searchsorted(term, term, "right") - first
    g, h, value = (np.zeros(0, np.int64) for _ in range(3))
    ends = np.cumsum(length)
    begin = 0
    while begin < len(term):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), "right")))
        k = length[begin:end]
        a = np.repeat(np.arange(begin, end), k)
        b = np.repeat(first[begin:end], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        a, b = a[a != b], b[a != b]
        more = _distance(share[a], share[b]) - _distance(share[a], none[b]) - _distance(none[a], share[b]) + _distance(none[a], none[b])
        g, h, value = np.append(g, ids[a]), np.append(h, ids[b]), np.append(value, more)
        order = np.lexsort((h, g))
        g, h, value = g[order], h[order], value[order]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))) if len(g) else np.zeros(0, np.int64)
        g, h, value = g[new], h[new], (np.add.reduceat(value, new) if len(new) else value)
        begin = end
    return pa.Table.from_batches([_pairs(g, h, value, lang)])


def _one_sided(table: pa.Table) -> pa.Table:
    """For the pairs of two blocks: all light terms as if no two sources shared one.

    Rows hold how many light terms a source has ``n`` times; ``n`` = 0 counts those that it lacks,
    so that each source has a row at least.
    """
    lang = table["lang"][0].as_py()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    table = table.sort_by([("id", "ascending"), ("n", "ascending")])
    ids, total, n, terms = (table[c].to_numpy() for c in ("id", "total", "n", "terms"))
    light = table["light"].to_numpy()[0]
    found = []
    for of, to in {(low, high), (high, low)}:
        rows, others = np.flatnonzero(ids // BLOCK == of), np.flatnonzero(ids // BLOCK == to)
        gs, at = np.unique(ids[rows], return_index=True)
        hs, ht = np.unique(ids[others], return_index=True)
        some = total[rows][at] > 0
        value = np.zeros((len(gs), len(hs)), np.int64)
        if some.all() and len(gs) and len(hs):  # a language keeps terms for all of its sources or for none
            p0, q0 = _shares(np.zeros(len(gs), np.int64), total[rows][at]), _shares(np.zeros(len(hs), np.int64), total[others][ht])
            plain = _distance(p0[:, None], q0[None, :])
            p, q = _shares(n[rows], total[rows]), _shares(n[others], total[others])
            value = plain * light
            step = max(1, (1 << 21) // len(hs))
            for begin in range(0, len(rows), step):
                end = min(begin + step, len(rows))
                owner = np.searchsorted(gs, ids[rows[begin:end]])
                more = terms[rows[begin:end], None] * (_distance(p[begin:end, None], q0[None, :]) - plain[owner])
                np.add.at(value, owner, more)
            step = max(1, (1 << 21) // len(gs))
            for begin in range(0, len(others), step):
                end = min(begin + step, len(others))
                owner = np.searchsorted(hs, ids[others[begin:end]])
                more = terms[others[begin:end], None] * (_distance(p0[None, :], q[begin:end, None]) - plain.T[owner])
                by_h = np.zeros((len(hs), len(gs)), np.int64)
                np.add.at(by_h, owner, more)
                value += by_h.T
        g, h = np.repeat(gs, len(hs)), np.tile(hs, len(gs))
        apart = g != h
        found.append(_pairs(g[apart], h[apart], value.ravel()[apart], lang))
    return pa.Table.from_batches(found)


def _both_blocks(df: DataFrame) -> DataFrame:
    """Each row once for each block that its source's block meets, as ``low`` and ``high``; ``blocks`` is their number."""
    own = F.floor(F.col("id") / BLOCK)
    return df.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *df.columns, F.least(own, "_other").alias("low"), F.greatest(own, "_other").alias("high")
    )


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    ``docs`` needs ``text, lang, source``; other columns are ignored. Nulls are empty strings. A
    term is a run of code points that are ASCII letters or not ASCII, A to Z in lower case; a
    language keeps those in at least ``least`` of its documents (rows, so repeated rows count). A
    share is ``p = 1 + floor(10^9 (n + 1) / (N + V))``, for a term that occurs ``n`` times of
    ``N`` kept, of ``V``; a distance is ``floor((p - q)^2 / q)``. Part ``pair`` has the sum of
    distances to each other source of the language, ``term`` the terms that a source has more of
    than its language, best ``top``. Ties go to the smaller item by its bytes. A source without
    terms, or a language that keeps none, has its pairs all the same, of 0 where no term is kept.
    A language of one source has no pairs. An empty table gives no rows.
    """
    key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*key, F.col("text"))
    # Tasks have added up what they read, so rows are dealt out before they are added up again.
    counted = saved(
        texts.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "source", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    # Rows of texts without terms have no counts, but their groups count.
    groups = saved(texts.select("lang", "source").distinct())
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    kept = saved(
        counted.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.count("*").alias("holders"))
        .where(F.col("docs") >= least)
        .drop("docs")
        .join(lookup(sources), "lang")
        .withColumn("heavy", (F.col("holders") > 1) & (F.col("holders") * heavy_share >= F.col("sources")))
        .drop("sources")
    )
    postings = saved(counted.drop("docs").join(kept, ["lang", "term"]))
    langs = saved(
        postings.groupBy("lang").agg(
            F.sum("n").alias("n_all"),
            F.count_if(~F.col("heavy")).alias("light_postings"),
        )
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.count_if("heavy").alias("heavy_terms")), "lang")
    )
    numbered = saved(_numbered(groups).join(lookup(langs), "lang", "left").join(lookup(sources), "lang"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
    some = F.coalesce("terms", F.lit(0).cast("long"))
    # ``total`` is N + V of a source, 0 if its language keeps no term.
    people = saved(
        numbered.join(own, ["lang", "source"], "left").select(
            "lang", "source", "id", (F.coalesce("n_own", F.lit(0)) + some).alias("total"), (F.coalesce("n_all", F.lit(0)) + some).alias("total_lang"),
            F.ceil((F.col("sources")) / BLOCK).alias("blocks"),
            F.greatest(F.ceil(F.coalesce("heavy_terms", F.lit(0)) / TILE_TERMS), F.lit(1)).alias("dense_tiles"),
            F.greatest(F.ceil(F.coalesce("light_postings", F.lit(0)) / TILE_POSTINGS), F.lit(1)).alias("sparse_tiles"),
            F.coalesce("heavy_terms", F.lit(0)).alias("heavy_terms"),
            (some - F.coalesce("heavy_terms", F.lit(0))).alias("light"),
        )
    )
    rows = postings.join(lookup(people), ["lang", "source"])

    tile = lambda tiles: F.pmod(F.xxhash64("term"), F.col(tiles))
    heavy = rows.where("heavy").select("lang", "id", "total", "term", "n", "blocks", tile("dense_tiles").alias("tile"))
    tiles = kept.where("heavy").join(lookup(people.select("lang", "dense_tiles").distinct()), "lang")
    tiles = tiles.groupBy("lang", tile("dense_tiles").alias("tile")).agg(F.count("*").alias("n"))
    heads = people.join(lookup(tiles), "lang")
    heads = heads.select("lang", "id", "total", F.lit(None).cast("string").alias("term"), "n", "blocks", "tile")
    dense = _both_blocks(heavy.unionByName(heads)).groupBy("lang", "tile", "low", "high").applyInArrow(_dense, _PAIR)

    light = rows.where(~F.col("heavy"))
    shared = light.where("holders > 1").select("lang", "id", "total", "term", "n", tile("sparse_tiles").alias("tile"))
    sparse = shared.groupBy("lang", "tile").applyInArrow(_sparse, _PAIR)

    shape = ["lang", "id", "total", "blocks", "light"]
    histogram = light.groupBy(*shape, "n").agg(F.count("*").alias("terms"))
    lacking = people.select(*shape, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("terms"))
    one_sided = _both_blocks(histogram.unionByName(lacking)).groupBy("lang", "low", "high").applyInArrow(_one_sided, _PAIR)

    pairs = dense.unionByName(sparse).unionByName(one_sided).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    name = lambda role: people.select("lang", F.col("id").alias(role), F.col("source").alias(f"{role}_name"))
    pairs = pairs.join(lookup(name("g")), ["lang", "g"]).join(lookup(name("h")), ["lang", "h"])
    pairs = pairs.select("lang", F.col("g_name").alias("source"), F.lit("pair").alias("part"), F.col("h_name").alias("item"), "value")

    p, q = _share(F.col("n"), F.col("total")), _share(F.col("n_lang"), F.col("total_lang"))
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = terms.where("p > q").select("lang", "source", "part", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    best = [F.desc("value"), F.asc("item")]
    # A group's terms are cut to the best of each of its parts first, so that no task sorts them all.
    part = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(32))).orderBy(*best)
    terms = terms.withColumn("_best", F.row_number().over(part)).where(F.col("_best") <= top).drop("_best")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*best))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)


def _numbered(groups: DataFrame) -> DataFrame:
    """``lang, source, id``: the sources of a language by their bytes, from 0."""
    return groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)

"""Record operators: de-duplication, lookups, fuzzy pairs, upserts, batches, splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut, unguessed


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; aggregated before the shuffle, so a hot key is one row per task."""
    best = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("r"))
    return best.select("r.*")


def last_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The last row of each key, aggregated as in ``first_by``."""
    best = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*df.columns), order).alias("r"))
    return best.select("r.*")


def lookup_last(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str, order: str, default: str = "") -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` that has its key, else ``default``."""
    last = right.where(F.coalesce(right_key, F.lit("")) != "").groupBy(F.col(right_key).alias("_k")).agg(F.max_by(value, order).alias("_v"))
    out = left.join(last, F.col(key) == F.col("_k"), "left")
    return out.select(*left.columns, F.coalesce("_v", F.lit(default)).alias(value))


def distinct_items(df: DataFrame, columns: Sequence[str], name: str = "item") -> DataFrame:
    """The distinct non-empty strings of several array columns; nulls count as empty arrays."""
    whole = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]))
    return df.select(F.explode(F.array_distinct(whole)).alias(name)).where(F.coalesce(F.col(name), F.lit("")) != "").distinct()


def distinct_json(df: DataFrame, text: str) -> DataFrame:
    """Distinct records by their canonical JSON; text that is no JSON is left out."""
    return df.select(T.canonical_json(F.col(text)).alias(text)).where(F.col(text).isNotNull()).distinct()


def _packs(df: DataFrame, name: str, rows: int, size: int) -> DataFrame:
    """The strings of a one-column table as rows of up to ``rows`` strings and about ``size`` characters, where they lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        length = 0
        row = lambda texts: pa.record_batch([pa.array([texts], pa.list_(pa.string()))], names=[name])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if held and (len(held) == rows or length + len(text) > size):
                    yield row(held)
                    held, length = [], 0
                held.append(text)
                length += len(text)
        if held:
            yield row(held)

    return df.mapInArrow(pack, f"{name} array<string>")


def contained_pairs(short: DataFrame, long: DataFrame, s: str, t: str, threshold: float = 0.0, *, patterns: int = 20_000, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """All pairs (s, t) of distinct strings where the first is part of the second and has at least ``threshold`` of its length.

    Short strings become Aho-Corasick automata of up to ``patterns`` strings, which run over the long ones, each long string once per automaton. If
    the smaller side is known to be small it is packed whole and broadcast, and the other one stays where it lies: an automaton of few short strings
    runs in every task, one of many is made in one task only.
    """
    some = lambda df, c: df.select(F.col(c).alias(c)).where(F.coalesce(F.col(c), F.lit("")) != "").distinct()
    a, b = some(short, s), some(long, t)
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0]
    of_a, of_b = size(a, s), size(b, t)
    few = min(of_a, of_b) <= broadcast_bytes
    blocks = _packs(a.coalesce(1) if few and of_a <= of_b else a, "_s", patterns, 1 << 22)
    texts = _packs(b.coalesce(1) if few and of_b < of_a else b, "_t", 200_000, 1 << 23)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known: dict[tuple, object] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                words, strings = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                key = (len(words), words[0], words[-1])
                if key not in known:
                    automaton = ahocorasick.Automaton()
                    for w in words:
                        automaton.add_word(w, w)
                    automaton.make_automaton()
                    known = {**known, key: automaton} if len(known) < 4 else {key: automaton}
                left: list[str] = []
                right: list[str] = []
                for text in strings:
                    least = threshold * len(text)
                    found = {w for _, w in known[key].iter(text) if len(w) >= least}
                    left += found
                    right += [text] * len(found)
                    if len(left) > 50_000:
                        yield pa.record_batch([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["s", "t"])
                        left, right = [], []
                yield pa.record_batch([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["s", "t"])

    # an automaton is known by its number of strings and its first and last one, as no string is in two; large packs of texts keep building it cheap
    if few and of_b < of_a:
        pairs = blocks.crossJoin(F.broadcast(texts))
    else:
        pairs = texts.crossJoin(F.broadcast(blocks) if few else blocks.hint("shuffle_replicate_nl"))
    return pairs.select("_s", "_t").mapInArrow(search, "s string, t string").toDF(s, t)


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, *, above: bool = False) -> DataFrame:
    """All pairs (a, b, similarity) of distinct strings whose containment similarity reaches ``threshold`` (``above``: exceeds it)."""
    low = lambda df, c: df.select(F.col(c), F.lower(c).alias(f"_{c}"))
    x = low(left.select(F.col(a)).where(F.coalesce(F.col(a), F.lit("")) != "").distinct(), a)
    y = low(right.select(F.col(b)).where(F.coalesce(F.col(b), F.lit("")) != "").distinct(), b)
    pairs = contained_pairs(x, y, f"_{a}", f"_{b}", threshold).union(contained_pairs(y, x, f"_{b}", f"_{a}", threshold).select(f"_{a}", f"_{b}")).distinct()
    out = pairs.join(unguessed(x), f"_{a}").join(unguessed(y), f"_{b}").select(a, b, T.containment(F.col(a), F.col(b)).alias("similarity"))
    return out.where(F.col("similarity") > threshold if above else F.col("similarity") >= threshold)


def upsert(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values win; keys of both sides stay."""
    n = new.select(key, F.col(value).alias("_new"))
    return base.select(key, value).join(n, key, "full").select(key, F.coalesce("_new", value).alias(value))


def upsert_rows(base: DataFrame, new: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """``base`` with the ``updated`` columns of rows of ``new`` of the same key (where not null), and the rows of new keys.

    A column ``action`` says ``kept``, ``updated`` or ``created``. ``new`` has one row per key; rows without a key are left out.
    """
    columns = [c for c in base.columns if c != key]
    given = new.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    n = given.select(F.col(key), F.lit(True).alias("_is_new"), *[F.col(c).alias(f"_n_{c}") for c in columns if c in given.columns])
    both = base.withColumn("_is_old", F.lit(True)).join(n, key, "full")

    def value(c: str) -> Column:
        if f"_n_{c}" not in n.columns:
            return F.col(c)
        old = F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in updated else F.col(c)
        return F.when(F.col("_is_old").isNull(), F.col(f"_n_{c}")).otherwise(old)

    action = F.when(F.col("_is_old").isNull(), "created").when(F.col("_is_new"), "updated").otherwise("kept").alias("action")
    return both.select(key, *[value(c).alias(c) for c in columns], action)


def find_by_link(wanted: DataFrame, pages: DataFrame, link: str, normal: Column, page_link: str, page_id: str) -> DataFrame:
    """(link, page_id, how) of each distinct link of ``wanted``: the page with that normal form, else the first that contains it, else the raw link."""
    asked = wanted.select(F.col(link).alias("_l"), normal.alias("_n")).where("_l <> ''").distinct()
    keyed = pages.select(F.col(page_link).alias("_p"), F.col(page_id).alias("_id"))
    exact = asked.join(keyed.groupBy(F.col("_p").alias("_n")).agg(F.min("_id").alias("_id")), "_n").select("_l", "_id", F.lit(1).alias("_t"))
    within = contained_pairs(asked, keyed, "_n", "_p").join(keyed, "_p").groupBy("_n").agg(F.min("_id").alias("_id"))
    part = asked.join(within, "_n").select("_l", "_id", F.lit(2).alias("_t"))
    raw = asked.join(keyed.groupBy(F.col("_p").alias("_l")).agg(F.min("_id").alias("_id")), "_l").select("_l", "_id", F.lit(3).alias("_t"))
    best = exact.unionByName(part).unionByName(raw).groupBy("_l").agg(F.min_by(F.struct("_id", "_t"), F.struct("_t", "_id")).alias("r"))
    how = F.element_at(F.array(F.lit("normal"), F.lit("contains"), F.lit("raw")), F.col("r._t"))
    return best.select(F.col("_l").alias(link), F.col("r._id").alias(page_id), how.alias("how"))


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Gapless row numbers from 1 in ``order``, without a sort in one task: counts per range partition give each its offset.

    The sorted partitions are written once, so that a later evaluation can't deal the rows differently.
    """
    sorted_ = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_i", F.monotonically_increasing_id()))
    rows = sorted_.withColumn("_p", F.shiftright("_i", 33))
    per = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = per.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inner = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + inner + 1).drop("_p", "_i", "_before")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Batch numbers from 1, ``size`` rows each."""
    return numbered(df, order, "_row").withColumn("batch", F.ceil(F.col("_row") / size)).drop("_row")


def train_dev_split(train: DataFrame, order: str, dev: DataFrame | None = None, *, share: float = 0.8, least: int = 10) -> DataFrame:
    """``train`` (and ``dev``) with a column ``split``. Without rows in ``dev``, the rows after the first ``share`` of more than
    ``least`` become dev."""
    if dev is not None and not dev.isEmpty():
        return train.withColumn("split", F.lit("train")).unionByName(dev.withColumn("split", F.lit("dev")))
    n = train.count()
    last = int(n * share) if n > least else n
    return numbered(train, order, "_row").withColumn("split", F.when(F.col("_row") <= last, "train").otherwise("dev")).drop("_row")


def switched_union(sources: dict[str, DataFrame], switches: dict[str, bool], split: str = "train") -> DataFrame | None:
    """The rows of all sources that are switched on, with their ``source`` and ``split``; None if there are none."""
    out = None
    for name, df in sources.items():
        if switches.get(name, False):
            part = df.withColumn("source", F.lit(name)).withColumn("split", F.lit(split))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def crawl(seeds: DataFrame, edges: DataFrame, link: str, target: str, depth: int = 1) -> DataFrame:
    """(link, depth): all links reachable from ``seeds`` over ``edges`` (link, target) within ``depth`` hops, each at its first depth."""
    seen = cut(seeds.select(F.col(link)).where(F.col(link).isNotNull()).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.select(link).join(edges.select(link, target), link).select(F.col(target).alias(link)).where(F.col(link).isNotNull()).distinct()
        frontier = cut(found.join(seen.select(link), link, "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def inline_images(pages: DataFrame, key: str, html: str, images: DataFrame, url: str, data: str) -> DataFrame:
    """``pages`` whose image sources (absolute) are replaced by the images found under them; others stay as they are."""
    from ..functions import html as H
    from ..functions import links as L

    found = pages.select(key, F.explode(F.array_distinct(H.image_sources(F.col(html)))).alias("_src"))
    known = images.where(F.col(data).isNotNull()).groupBy(F.col(url).alias("_url")).agg(F.min(data).alias("_data"))
    hits = found.join(known, L.absolute_src(F.col("_src")) == F.col("_url"))
    by = hits.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("_src", "_data"))).alias("_hits"))
    out = pages.join(by, F.col(key).eqNullSafe(F.col("_k")), "left")
    put = lambda text, hit: F.replace(text, F.concat(F.lit('src="'), hit["_src"], F.lit('"')), F.concat(F.lit('src="'), H.data_uri(hit["_data"]), F.lit('"')))
    swapped = F.when(F.col("_hits").isNull(), F.col(html)).otherwise(F.aggregate("_hits", F.col(html), put))
    return out.select(*[swapped.alias(c) if c == html else F.col(c) for c in pages.columns])

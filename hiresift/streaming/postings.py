"""The stored postings: appended in order of arrival, with an index of their keys, in versions.

A version names the folders of rows and of index entries, the next arrival number, and for every stream the last batch it
took in. A batch is compared with the index alone, so its cost follows the batch; it becomes visible
together with its index entries and its batch number, so a batch that is replayed adds nothing, and a stream with a new
checkpoint adds to what is there and can neither lose nor double a posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.operators import keyindex
from hiresift.operators.dedup import first_of_two_keys, losers, with_key
from hiresift.operators.order import numbered
from hiresift.session import cut
from hiresift.sources.versions import Versions

REJECTS = "feed string, file string, payload string, reason string"
KINDS = ("job", "dup")
COLUMNS = [f.name for f in S.JOBS.fields]


# So many numbers of new postings may be broadcast, in words of 64 rows: 8 bytes each, and 32 for a word.
MOST_MARKS = 1 << 22


def marked(rows: DataFrame, chosen: DataFrame, most: int = MOST_MARKS) -> DataFrame:
    """The rows whose number ``_row`` is among the chosen ones, with their id; chosen (_row, id) is a written table.

    One bit tells of each row whether it stays, and the ids of those that stay lie beside the bits, so no text travels here.
    More than ``most`` chosen numbers meet the rows in a join.
    """
    if chosen.count() > most:
        return rows.join(chosen.select("_row", "id"), "_row")
    one, place = F.lit(1).cast("long"), (F.col("_row") % 64).cast("int")
    bit = F.call_function("shiftleft", one, place)
    word = F.floor(F.col("_row") / 64).alias("_word")
    words = chosen.groupBy(word).agg(
        F.bit_or(bit).alias("_bits"), F.transform(F.array_sort(F.collect_list(F.struct("_row", "id"))), lambda r: r["id"]).alias("_ids"))
    met = rows.select("*", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    below = F.bitwise_not(F.call_function("shiftleft", -one, place))
    earlier = F.bit_count(F.col("_bits").bitwiseAND(below))
    return met.select(*rows.columns, F.get("_ids", earlier).alias("id"))


class PostingTable:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = keyindex.BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.versions = Versions(spark, folder)

    # --- reading ----------------------------------------------------------------------------------

    def rows(self, content: dict | None = None) -> DataFrame:
        """All stored postings. They lie by source and sorted by job type, so filters on these prune folders and row groups."""
        return self._placed(self._content(content).get("rows", [])).select(*COLUMNS)

    def index(self, kind: str, content: dict | None = None) -> DataFrame:
        """Entries (hash, key, id, size, bucket) of kind "job" (job_id) or "dup" (duplicate key)."""
        return self.versions.load(self._content(content).get(kind, []), keyindex.SCHEMA)

    def rejects(self) -> DataFrame:
        return self.versions.load(self._content(None).get("rejects", []), REJECTS)

    def _content(self, content: dict | None) -> dict:
        return self.versions.last()[1] if content is None else content

    def _placed(self, places: list[str]) -> DataFrame:
        """The rows of some places: load=.../source=..."""
        return self.versions.load([f"{self.folder}/rows/{p}" for p in places], S.JOBS)

    # --- writing ----------------------------------------------------------------------------------

    def _write_rows(self, rows: DataFrame) -> list[str]:
        """Write postings by source, sorted by job type, and return their places. An empty source reads back as null."""
        # several tasks write a source that holds most rows
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        dealt = rows.select(*COLUMNS).repartition("source", F.pmod(F.xxhash64("id"), F.lit(tasks)))
        path = self.versions.write("rows", dealt.sortWithinPartitions("source", "job_type", "id"), "source")
        return [f"{path.rsplit('/', 1)[1]}/{name}" for name in self.versions.folders(path)]

    def load(self, rows: DataFrame) -> int:
        """Take rows with their arrival numbers as they are into an empty table; they may hold duplicates."""
        def work(content: dict) -> dict:
            if content:
                raise ValueError(f"{self.folder} holds postings already; append to it")
            keyed = cut(with_key(rows).withColumn("size", keyindex.size_of(F.col("description"))))
            return self._added({"buckets": self.buckets, "next": 1, "seen": {}}, keyed, keyed)
        return self.versions.change(work)[0]

    def _added(self, content: dict, rows: DataFrame, keys: DataFrame) -> dict:
        """The content with these rows and their entries; keys, a written table, has id, job_id, dkey and size of the same rows."""
        top = keys.agg(F.max("id")).first()[0]
        if top is None:
            return content
        more = {"rows": self._write_rows(rows)}
        for kind in KINDS:
            more[kind] = [self.versions.write(kind, keyindex.index_rows(keys, kind, content["buckets"]), "bucket")]
        return content | {k: [*content.get(k, []), *paths] for k, paths in more.items()} | {"next": max(content["next"], top + 1)}

    def append(
        self, batch: DataFrame, order: list[str], stream: str, number: int,
        loaded_at: Column | None = None, rejects: DataFrame | None = None, ids: str | None = None,
    ) -> int:
        """Take in what is new of a batch: unknown job_id and unknown duplicate key, first of their kind in ``order``.

        The columns of ``order`` are unique. New postings are numbered on from the last one, or carry their own number in
        the column ``ids``, which is then the order; they keep their created_at, or get ``loaded_at`` (by default the time of the load). A batch number of a stream that was taken in before changes nothing. Returns the version.
        """
        if loaded_at is None:
            loaded_at = F.col("created_at") if "created_at" in batch.columns else F.current_timestamp()
        made: list[DataFrame] = []

        def work(content: dict) -> dict | None:
            content = content or {"buckets": self.buckets, "next": 1, "seen": {}}
            if content["seen"].get(stream, -1) >= number:
                return None
            if not made:  # once, also where another writer is faster
                keyed = with_key(batch).select(
                    F.struct(*order).alias("_at"), "dkey", keyindex.size_of(F.col("description")).alias("size"),
                    *[f.name for f in S.POSTING.fields], loaded_at.alias("created_at"))
                made.append(cut(keyed.withColumn("_row", F.monotonically_increasing_id()), codec="zstd"))  # the whole texts
                arrived = made[0].select("_row", "_at", "job_id", "dkey", "size")
                # numbers that the rows carry need no counting
                arrived = arrived.withColumn("_seq", F.col(f"_at.{ids}")) if ids else cut(numbered(arrived, "_seq", 1, "_at"))
                made.append(arrived.drop("_at"))
            rows, keys = made
            fresh = keys
            for kind in KINDS if content.get("rows") else ():
                fresh = keyindex.unknown(fresh, kind, self.index(kind, content), content["buckets"])
            first = keys.join(first_of_two_keys(fresh, "_seq"), "_seq", "left_semi")
            # from here on the keys of the new postings are enough, but for the rows that are stored
            chosen = cut(first.withColumn("id", F.col("_seq")) if ids else numbered(first, "id", content["next"], "_seq"))
            content = self._added(content, marked(rows, chosen), chosen)
            if rejects is not None:
                content = content | {"rejects": [*content.get("rejects", []), self.versions.write("rejects", rejects)]}
            return content | {"seen": content["seen"] | {stream: number}}

        return self.versions.change(work)[0]

    def clean(self) -> int:
        """Remove the duplicates of a loaded table: of each duplicate key the longest description stays, on a tie the smallest id.

        Losers are found in the index. Only the places that hold one are written anew, the others are named again as they are.
        """
        def work(content: dict) -> dict | None:
            keys = self.index("dup", content).select(F.col("key").alias("dkey"), "id", "size")
            gone = cut(losers(keys))
            if gone.isEmpty():
                return None
            # the place of a row, from its file: at most as many values as there are folders
            file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            placed = self._placed(content["rows"]).select("id", F.regexp_extract(file, "(load=[^/]+/[^/]+)/[^/]+$", 1).alias("place"))
            found = {r.place for r in placed.join(gone, "id", "left_semi").select("place").distinct().collect()}
            touched = [p for p in content["rows"] if p in found]
            kept = self._placed(touched).join(gone, "id", "left_anti")
            new = {"rows": [*[p for p in content["rows"] if p not in touched], *self._write_rows(kept)]}
            return content | new | self._compacted(content, gone)
        return self.versions.change(work)[0]

    def compact(self) -> int:
        """Write the index entries of all batches together, so that a batch opens one folder for each bucket."""
        return self.versions.change(lambda content: content | self._compacted(content))[0]

    def _compacted(self, content: dict, gone: DataFrame | None = None) -> dict:
        out = {}
        for kind in KINDS:
            entries = self.index(kind, content)
            entries = entries if gone is None else entries.join(gone, "id", "left_anti").select(*entries.columns)
            out[kind] = [self.versions.write(kind, keyindex.laid_out(entries), "bucket")]
        return out

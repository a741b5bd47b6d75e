"""An index of texts: which trigrams each file holds, kept current by an ordered log.

On disk are base folders and log folders by batch. A base holds ``files`` (file_id, content_hash, mod_time) and ``postings``
(key, file_id), sorted by key; a batch holds changes (seq, op, file_id, content_hash, mod_time, keys, crc), ADD with all
trigrams of the new text or REMOVE. A batch that is written again replaces itself. Readers take the newest whole base
and, of each file, the last change of the later batches, up to the first whose checksum is wrong.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as functions
from lodestone.operators import content, postings
from lodestone.operators.search import ranked
from lodestone.sources.scan import read_log, with_checksum

FILES = "file_id long, content_hash long, mod_time long"
POSTINGS = "key string, file_id long"
CHANGES = "seq long, op string, file_id long, content_hash long, mod_time long, keys array<string>, crc long"


def keyed(texts: DataFrame) -> DataFrame:
    """texts (file_id, text, mod_time) with their hash and their trigrams."""
    return texts.select("file_id", F.xxhash64("text").alias("content_hash"), "mod_time", functions.trigrams(F.col("text")).alias("keys"))


@dataclass
class ContentIndex:
    spark: SparkSession
    path: str

    def _numbers(self, kind: str, mark: str) -> list[int]:
        """Numbers of the folders of a kind that were written to the end."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        where = hadoop(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if fs.exists(hadoop(s.getPath(), mark)))

    def _base(self) -> int:
        return max(self._numbers("base", "files/_SUCCESS"), default=-2)

    def _write(self, files: DataFrame, lists: DataFrame, upto: int) -> None:
        where = f"{self.path}/base/upto={upto}"
        postings.save(lists.select("key", "file_id"), f"{where}/postings")
        files.select("file_id", "content_hash", "mod_time").write.mode("overwrite").parquet(f"{where}/files")  # last: it makes the base whole

    def build(self, texts: DataFrame, allowed=None) -> None:
        """Index all texts (file_id, text, mod_time) anew, or those that the condition ``allowed`` takes."""
        own = keyed(texts if allowed is None else texts.filter(allowed))
        self._write(own, own.select("file_id", F.explode("keys").alias("key")), max([self._base(), *self._numbers("log", "_SUCCESS"), -1]) + 1)

    def clear(self) -> None:
        """Forget all files; earlier bases and batches don't count any more."""
        self._write(self.spark.createDataFrame([], FILES), self.spark.createDataFrame([], POSTINGS), max([self._base(), *self._numbers("log", "_SUCCESS"), -1]) + 1)

    def _batches(self) -> list[int]:
        base = self._base()
        return [b for b in self._numbers("log", "_SUCCESS") if b > base]

    def _changes(self) -> DataFrame | None:
        """The last change of each file since the base, from the log's valid prefix."""
        batches = self._batches()
        if not batches:
            return None
        log = read_log(self.spark, *(f"{self.path}/log/batch={b}" for b in batches))
        return log.groupBy("file_id").agg(F.max_by(F.struct("op", "content_hash", "mod_time", "keys"), "seq").alias("c")).select("file_id", "c.*")

    def files(self) -> DataFrame:
        """(file_id, content_hash, mod_time) of the indexed files."""
        base, changes = self._base(), self._changes()
        files = self.spark.read.schema(FILES).parquet(f"{self.path}/base/upto={base}/files") if base >= 0 else self.spark.createDataFrame([], FILES)
        if changes is None:
            return files
        return files.join(changes.select("file_id"), "file_id", "left_anti").unionByName(changes.filter("op = 'ADD'").select("file_id", "content_hash", "mod_time"))

    def count(self) -> int:
        """How many files are indexed."""
        return self.files().count()

    def postings(self) -> DataFrame:
        """(key, file_id) of the indexed files; those of changed files come from the log."""
        base, changes = self._base(), self._changes()
        lists = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/base/upto={base}/postings") if base >= 0 else self.spark.createDataFrame([], POSTINGS)
        if changes is None:
            return lists
        return postings.maintain(lists, changes, changes.filter("op = 'ADD'").select(F.explode("keys").alias("key"), "file_id"))

    def append(self, changes: DataFrame, batch: int) -> None:
        """Log changes (seq, op, file_id, content_hash, mod_time, keys), with checksums; idempotent by batch."""
        if batch > self._base():
            rows = changes.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGES.split(", ")[:-1]))
            with_checksum(rows).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def refresh(self, texts: DataFrame, batch: int) -> DataFrame:
        """Log what of all texts (file_id, text, mod_time) is new or changed, and what is gone; (file_id, content_hash,
        mod_time, change) of every file. Texts of an equal time or hash aren't read for trigrams."""
        states = content.refresh(self.files(), texts)
        upserted = keyed(texts.join(states.filter("change = 'upserted'").select("file_id"), "file_id", "left_semi")).withColumn("op", F.lit("ADD"))
        removed = states.filter("change = 'removed'").select("file_id", "content_hash", "mod_time", F.array().cast("array<string>").alias("keys"), F.lit("REMOVE").alias("op"))
        # one change a file and batch, so the batch's number orders them
        self.append(upserted.unionByName(removed).withColumn("seq", F.lit(batch).cast("long")), batch)
        return states

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Log the removal of file_ids."""
        gone = ids.select("file_id").distinct()
        none = F.lit(None).cast("long")
        self.append(gone.select(F.lit(batch).cast("long").alias("seq"), F.lit("REMOVE").alias("op"), "file_id", none.alias("content_hash"), none.alias("mod_time"), F.array().cast("array<string>").alias("keys")), batch)

    def remove_prefix(self, catalog: DataFrame, prefix: str, batch: int) -> None:
        """Log the removal of the files of a subtree."""
        self.remove(catalog.filter(functions.stored_within(prefix)), batch)

    def compact(self) -> None:
        """A new base from the base and the log."""
        batches = self._batches()
        if batches:
            self._write(self.files(), self.postings(), batches[-1])

    def candidates(self, keyword: str) -> DataFrame:
        """file_ids of indexed files that hold all trigrams of the keyword; none for shorter keywords."""
        key = content.key_of(keyword)
        keys = sorted({key[i : i + 3] for i in range(len(key) - 2)})
        return postings.all_of(self.postings(), keys) if keys else self.files().select("file_id")

    def hits(self, texts: DataFrame, keyword: str) -> DataFrame:
        """(file_id, match_offset, snippet) of the indexed texts that hold the keyword: a semi-join with the candidates, of
        which each is verified on its text."""
        return content.content_hits(texts.join(self.candidates(keyword), "file_id", "left_semi"), keyword)

    def search(self, texts: DataFrame, keyword: str, limit: int = content.LARGEST_LIMIT) -> DataFrame:
        """The first hits by id, with ``rank``."""
        return ranked(self.hits(texts, keyword), min(limit, content.LARGEST_LIMIT), [F.col("file_id")])

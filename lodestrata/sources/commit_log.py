"""A commit log as a Parquet table: optimistic writers, immutable batches, snapshots for readers."""

from __future__ import annotations

import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestrata.operators import timetravel

SCHEMA = T.StructType(
    [T.StructField("txn_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]
)
#: Limits of one commit.
MAX_OPS, MAX_KEY, MAX_VALUE = 1_000, 4 << 10, 16 << 20


class WriteBusy(RuntimeError):
    """Another write transaction is open."""


class CommitConflict(RuntimeError):
    """Another writer committed after this transaction began."""


class CommitLog:
    """Opens the log at ``path``, or an empty one.

    Within one log object a single write transaction is open at a time. Writers of other sessions are found out at the commit: a
    transaction claims the number that follows the last one it saw, by a file that only one writer can create.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._writer = spark, path, threading.Lock()

    def _file(self, *names: str):
        """A path below the log, and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def frame(self) -> DataFrame:
        """All committed mutations."""
        where, files = self._file()
        if not files.exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def claim(self, txn_id: int) -> None:
        """Take a transaction number for good; raises :class:`CommitConflict` if it is taken. Readers skip the folder, as its name begins with ``_``."""
        where, files = self._file("_claims", str(txn_id))
        try:
            files.create(where, False).close()
        except Py4JJavaError as error:
            if files.exists(where):
                raise CommitConflict(txn_id) from None
            raise error

    def release(self, txn_id: int) -> None:
        """Give up the claim of a transaction that was never written, as after a crash between claim and commit."""
        if timetravel.has_snapshot(self.frame(), txn_id):
            raise ValueError(f"transaction {txn_id} is committed")
        where, files = self._file("_claims", str(txn_id))
        files.delete(where, False)

    def read(self, txn_id: int | None = None) -> DataFrame:
        """The state as of a transaction, or the latest."""
        return timetravel.as_of(self.frame(), txn_id)

    def get(self, key: bytes, txn_id: int | None = None) -> bytes | None:
        """The value of a key; None if it isn't there. The key's filter reaches the scan."""
        row = timetravel.as_of(self.frame().where(F.col("key") == F.lit(key)), txn_id, check=False).first()
        return None if row is None or row["value"] is None else bytes(row["value"])

    def begin(self) -> WriteTransaction:
        if not self._writer.acquire(blocking=False):
            raise WriteBusy(self.path)
        try:
            return WriteTransaction(self)
        except BaseException:
            self._writer.release()
            raise

    def append(self, mutations: DataFrame, by_key: bool = False) -> None:
        """Append a batch that carries its own ``txn_id`` and ``seq``; the job's commit makes it visible as a whole.

        Large batches go ``by_key``: ranges of keys make files, sorted by key and transaction, so that their statistics let a point get
        or a range scan skip all others.
        """
        rows = mutations.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])
        if by_key:
            rows = rows.repartitionByRange("key", "txn_id", "seq").sortWithinPartitions("key", "txn_id", "seq")
        rows.write.mode("append").parquet(self.path)

    def truncate(self, upto: int, into: str) -> CommitLog:
        """A compacted copy of the log, laid out by key, with the same snapshots from ``upto`` on."""
        other = CommitLog(self.spark, into)
        other.append(timetravel.compact(self.frame(), upto), by_key=True)
        return other


class WriteTransaction:
    """Buffered mutations of the one open writer, on top of the last snapshot when it began."""

    def __init__(self, log: CommitLog) -> None:
        self.log, self.rows, self.base = log, [], timetravel.latest_snapshot(log.frame())

    def put(self, key: bytes, value: bytes | None) -> None:
        if len(key) > MAX_KEY or len(value or b"") > MAX_VALUE or len(self.rows) >= MAX_OPS:
            raise ValueError("beyond the limits of a commit")
        self.rows.append(("put", key, value))

    def delete(self, key: bytes) -> None:
        if len(key) > MAX_KEY or len(self.rows) >= MAX_OPS:
            raise ValueError("beyond the limits of a commit")
        self.rows.append(("del", key, None))

    def get(self, key: bytes) -> bytes | None:
        """The writer's own last mutation of the key, else the committed value."""
        for op, k, value in reversed(self.rows):
            if k == key:
                return value if op == "put" else None
        return self.log.get(key, self.base)

    def commit(self) -> int:
        """The new transaction's id; raises :class:`CommitConflict`, and writes nothing, if another writer was first.

        A transaction without mutations leaves no trace.
        """
        try:
            if not self.rows:
                return self.base
            txn = self.base + 1
            if timetravel.has_snapshot(self.log.frame(), txn):  # appended with its own numbers
                raise CommitConflict(txn)
            self.log.claim(txn)
            try:
                self.log.append(self.log.spark.createDataFrame([(txn, i, op, bytearray(k), None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(self.rows)], SCHEMA))
            except BaseException:
                self.log.release(txn)
                raise
            return txn
        finally:
            self._close()

    def abort(self) -> None:
        self._close()

    def _close(self) -> None:
        self.rows = []
        if self.log._writer.locked():
            self.log._writer.release()

"""Features by content, laid out for lookup: rows in hash buckets of the content's digest, filters of the stored digests, one
commit per put.

A store of one kind and encoder has a log (`commits`), homes and filters. A home is a bucketed table, a put one partition of it,
so files joined by digest meet it without a shuffle of the store. A log entry names the home, the puts that count, the columns and the
number of rows; what a failed put leaves is named by no entry. The table is known to the session's catalog by a digest of its path.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightsift.session import written

from . import commits
from .snapshots import _fs

#: Buckets of a new store, rows of a bucket from which on it is laid out anew with more of them, rows of a bucket then.
BUCKETS, FULL, LAID = 8, 1_000_000, 250_000
#: Puts that a home collects before it is written as one.
PUTS = 16
#: A filter has 16 to 32 bits a digest and 4 places for each: at most 3 of 1,000 unknown digests are asked for in the store.
BITS, PLACES = 16, 4


class Moved(Exception):
    """Another writer has changed the store meanwhile."""


def places(h: np.ndarray, size: int) -> np.ndarray:
    """PLACES bit numbers for each hash, size being a power of two."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((h[:, None] + np.arange(1, PLACES + 1, dtype=np.uint64) * step[:, None]) >> np.uint64(7)) & np.uint64(size - 1)


def filter_of(h: np.ndarray) -> bytes:
    size = max(64, 1 << int(np.ceil(np.log2(BITS * max(len(h), 1)))))
    bits = np.zeros(size, bool)
    bits[places(h, size).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_hold(stored: bytes, h: np.ndarray) -> np.ndarray:
    at = places(h, 8 * len(stored)).astype(np.int64)
    bits = np.frombuffer(stored, np.uint8)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def celled(rows: DataFrame, buckets: int) -> DataFrame:
    """sha1, its hash and the filter that it belongs to."""
    h = F.xxhash64("sha1")
    return rows.select("sha1", h.alias("h"), F.pmod(h, F.lit(buckets)).cast("int").alias("cell"))


def ddl(entry: dict) -> str:
    """The columns of a store as Spark reads them."""
    return ", ".join(f"`{n}` {kind}" for n, kind in entry["columns"])


def one_each(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest, of several always the same one; dealt to the buckets, which is the only shuffle of a put."""
    rest = [c for c in rows.columns if c != "sha1"]
    order = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    dealt = rows.withColumn("_o", order).repartition(buckets, "sha1")
    return dealt.withColumn("_n", F.row_number().over(Window.partitionBy("sha1").orderBy("_o"))).where("_n = 1").drop("_n", "_o")


@dataclass(frozen=True)
class Store:
    """The features of a kind and encoder under root: rows (sha1 and columns of their own), one per digest; the first put of a
    digest stays. Null digests are kept out. Any number of writers."""

    spark: SparkSession
    root: str
    kind: str
    encoder_id: str

    @property
    def at(self) -> str:
        return f"{self.root}/kind={quote(self.kind, safe='')}/encoder_id={quote(self.encoder_id, safe='')}"

    def entry(self) -> dict | None:
        """The last log entry with its number; None if nothing was ever stored."""
        last = commits.numbers(self.spark, f"{self.at}/log")
        return commits.read(self.spark, f"{self.at}/log", last[-1]) | {"number": last[-1]} if last else None

    def rows(self, entry: dict | None = None, puts: list[str] | None = None) -> DataFrame | None:
        """The stored rows (of some puts only, if asked)."""
        e = entry or self.entry()
        if e is None:
            return None
        home = f"{self.at}/{e['home']}"
        name = f"lightsift_{hashlib.sha256(home.encode()).hexdigest()[:24]}"
        place = home.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl(e)}, put STRING) USING parquet PARTITIONED BY (put) CLUSTERED BY (sha1) SORTED BY (sha1) INTO {e['buckets']} BUCKETS LOCATION '{place}'")
        if e["puts"]:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (put='{p}')" for p in e["puts"]))
        return self.spark.table(name).where(F.col("put").isin(e["puts"] if puts is None else puts)).select(*[f"`{n}`" for n, _ in e["columns"]])

    def missing(self, wanted: DataFrame, entry: dict | None = None) -> DataFrame:
        """The distinct digests (sha1) of wanted that are not stored. Only they and the filters are shuffled; digests that no filter
        knows are settled by that, the few others are looked up in their buckets, where the store's rows stay in place."""
        e, asked = entry or self.entry(), wanted.select("sha1").where("sha1 IS NOT NULL").distinct()
        if e is None or not e["puts"]:
            return asked
        filters = self.spark.read.schema("cell int, bits binary").parquet(*[f"{self.at}/{e['home']}-filters/{p}" for p in e["puts"]])

        def tested(keys: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            h, maybe = keys["h"].to_numpy(np.int64), np.zeros(len(keys), bool)
            for bits in stored["bits"] if len(keys) else ():
                maybe |= may_hold(bits, h)
            return pd.DataFrame({"sha1": keys["sha1"], "maybe": maybe})

        told = written(celled(asked, e["buckets"]).groupBy("cell").cogroup(filters.groupBy("cell")).applyInPandas(tested, "sha1 string, maybe boolean"))
        new, maybe = told.where("NOT maybe").select("sha1"), told.where("maybe").select("sha1")
        return new if maybe.isEmpty() else new.unionByName(self.not_in(maybe, self.rows(e)))

    def not_in(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        return rows.join(stored.select("sha1"), "sha1", "left_anti")

    def put(self, new: DataFrame, tested: dict | None = None, tries: int = 20) -> None:
        """Store the rows of new whose digests are not stored yet. `tested` is the entry that new was tested against, if it was: only
        puts after that are looked at. When another writer commits first, what it has stored is taken off and the rest written again."""
        e, seen = self.entry(), tested
        todo = new.where("sha1 IS NOT NULL")
        if e is not None and seen is None:
            todo, seen = todo.join(self.missing(todo, e), "sha1", "left_semi"), e
        for _ in range(tries):
            start = e or {"home": f"data-{uuid.uuid4().hex}", "buckets": BUCKETS, "puts": [], "n": 0, "columns": [[f.name, f.dataType.simpleString()] for f in todo.schema.fields], "number": -1}
            if set(todo.columns) != {n for n, _ in start["columns"]}:
                raise ValueError(f"the store has columns {start['columns']}, not {todo.columns}")
            rows = one_each(todo.select(*[F.col(f"`{n}`").cast(kind) for n, kind in start["columns"]]), start["buckets"])
            later = start["puts"] if seen is None or seen["home"] != start["home"] else [p for p in start["puts"] if p not in seen["puts"]]
            if later:
                rows = self.not_in(rows, self.rows(start, later))
            put = self.write(start["home"], start["buckets"], rows)
            n = self.spark.read.schema(ddl(start)).parquet(f"{self.at}/{start['home']}/put={put}").count()
            if not n and e is not None:
                self.drop(f"{start['home']}/put={put}", f"{start['home']}-filters/{put}")
                return
            try:
                self.commit(start, {"puts": [*start["puts"], *[put][:n]], "n": start["n"] + n})
            except Moved:
                todo, seen = self.spark.read.schema(ddl(start)).parquet(f"{self.at}/{start['home']}/put={put}"), start
                e = self.entry()
                continue
            if len(start["puts"]) >= PUTS or start["n"] + n > FULL * start["buckets"]:
                self.tidy()
            return
        raise commits.Lost(self.at)

    def write(self, home: str, buckets: int, rows: DataFrame) -> str:
        """A put's rows as bucket files and the filters of their digests; nothing counts before the commit. Returns its name."""
        put = uuid.uuid4().hex
        path, name = f"{self.at}/{home}/put={put}", f"lightsift_put_{put}"
        rows.write.bucketBy(buckets, "sha1").sortBy("sha1").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        keys = celled(self.spark.read.schema(rows.schema).parquet(path), buckets)
        made = keys.select("cell", "h").groupBy("cell").applyInPandas(lambda p: pd.DataFrame({"cell": p["cell"][:1], "bits": [filter_of(p["h"].to_numpy(np.int64))]}), "cell int, bits binary")
        made.write.parquet(f"{self.at}/{home}-filters/{put}")
        return put

    def commit(self, before: dict, changed: dict) -> None:
        """Append the entry after `before` with what changed; Moved if another is there by now."""

        def make(n: int) -> dict:
            if n != before["number"] + 1:
                raise Moved(self.at)
            return {k: v for k, v in before.items() if k != "number"} | changed

        n, _ = commits.append(self.spark, f"{self.at}/log", make)
        fs, path = _fs(self.spark, self.at)
        for old in commits.numbers(self.spark, f"{self.at}/log"):
            if old < n - 4:
                fs.delete(path(commits.entry_path(f"{self.at}/log", old)), False)

    def tidy(self) -> None:
        """Lay the store out anew if it has many puts or full buckets: one put in a new home, with buckets for its rows. The home
        before stays for its readers until the next time. A writer that commits meanwhile wins; then nothing changes."""
        e = self.entry()
        if e is None or (len(e["puts"]) <= PUTS and e["n"] <= FULL * e["buckets"]):
            return
        home, buckets = f"data-{uuid.uuid4().hex}", max(e["buckets"], -(-e["n"] // LAID))
        put = self.write(home, buckets, self.rows(e).repartition(buckets, "sha1"))
        try:
            self.commit(e, {"home": home, "buckets": buckets, "puts": [put], "before": e["home"]})
        except Moved:
            self.drop(home, f"{home}-filters")
            return
        if old := e.get("before"):
            self.drop(old, f"{old}-filters")

    def drop(self, *names: str) -> None:
        fs, path = _fs(self.spark, self.at)
        for name in names:
            fs.delete(path(f"{self.at}/{name}"), True)


def stores(spark: SparkSession, root: str, kind: str | None = None, encoder_id: str | None = None) -> list[Store]:
    """The stores under root of a kind and encoder (of all, if None)."""
    fs, path = _fs(spark, root)

    def below(at: str, name: str) -> list[str]:
        found = [s.getPath().getName() for s in fs.listStatus(path(at))] if fs.exists(path(at)) else []
        return sorted(n for n in found if n.startswith(f"{name}="))

    pairs = [(k, e) for k in below(root, "kind") for e in below(f"{root}/{k}", "encoder_id")]
    named = [(unquote(k.partition("=")[2]), unquote(e.partition("=")[2])) for k, e in pairs]
    return [Store(spark, root, k, e) for k, e in named if kind in (None, k) and encoder_id in (None, e)]


def put_features(spark: SparkSession, root: str, new: DataFrame) -> None:
    """Store features (sha1, kind, encoder_id, ...) under root; what is there by key already stays as it is."""
    rows = written(new.where("kind IS NOT NULL AND encoder_id IS NOT NULL"))
    for r in rows.select("kind", "encoder_id").distinct().collect():  # kinds and encoders are few
        own = rows.where((F.col("kind") == r["kind"]) & (F.col("encoder_id") == r["encoder_id"]))
        Store(spark, root, r["kind"], r["encoder_id"]).put(own.drop("kind", "encoder_id"))


def get_features(spark: SparkSession, root: str, kind: str | None = None, encoder_id: str | None = None) -> DataFrame | None:
    """The stored features of a kind and encoder, with both as columns; None if nothing was ever stored."""
    out = None
    for s in stores(spark, root, kind, encoder_id):
        rows = s.rows()
        if rows is not None:
            rows = rows.withColumns({"kind": F.lit(s.kind), "encoder_id": F.lit(s.encoder_id)})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_features(spark: SparkSession, root: str, files: DataFrame, compute: Callable[[DataFrame], DataFrame], kind: str, encoder_id: str) -> DataFrame:
    """files (sha1, ...) joined with their features; those not stored yet are computed once per content and stored first.

    compute gets (sha1, kind, encoder_id) and returns sha1 with its columns. Files without a digest are left out.
    """
    store = Store(spark, root, kind, encoder_id)
    before = store.entry()
    todo = written(store.missing(files, before))
    if before is None or not todo.isEmpty():  # the first time even if empty: the store learns its columns
        made = compute(todo.withColumns({"kind": F.lit(kind), "encoder_id": F.lit(encoder_id)}))
        store.put(made.drop("kind", "encoder_id"), before)
    return files.join(store.rows(), "sha1")

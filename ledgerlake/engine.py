"""The engine's face: one object per environment, with the verbs of a versioned record store."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import Link, ResolvableLink, Scalar, Triple, infer, operator_of
from .operators import calc, navigate, order, read, search, temporal, write
from .operators.find import Finder
from .plans import ccl
from .plans.ccl import Page, Query, Sort, Where
from .plans.times import Clock, now, to_micros
from .sources.log import COLUMNS, REVISIONS, LogStore, fold, snapshot

VERSION = "0.1.0"


class Reader:
    """All reads, over any store. Times are micros, datetimes or phrases; conditions are texts, builders or trees."""

    def __init__(self, store, spark: SparkSession, clock: Clock = now):
        self.store, self.spark, self.clock = store, spark, clock

    def _at(self, at) -> int | None:
        return None if at is None else to_micros(at, self.clock)

    def query(self, condition, data: dict | None = None) -> Query:
        if isinstance(condition, Where):
            return Query(condition.tree)
        if isinstance(condition, Query):
            return condition
        return ccl.parse(condition, data, self.clock) if isinstance(condition, str) else Query(condition)

    def ids(self, records: Iterable[int]) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"record": pa.array(list(records), pa.int64())}))

    def _records(self, of, at: int | None = None, data: dict | None = None, sort: Iterable[Sort] = (), page: Page | None = None) -> DataFrame | None:
        """(record) of ids, a condition, a DataFrame, or None for all."""
        if of is None or isinstance(of, DataFrame):
            found, q = of, Query(None)
        elif isinstance(of, int):
            found, q = self.ids([of]), Query(None)
        elif isinstance(of, list | tuple | set):
            found, q = self.ids(of), Query(None)
        else:
            q = self.query(of, data)
            found = Finder(self.store).find(q.condition)
        by, cut = tuple(sort) or q.order, page or q.page
        if by or cut:
            found = order.arrange(self.store, self.store.inventory() if found is None else found, by, cut, at)
        return found

    # predicates
    def find(self, condition, order_by: Iterable[Sort] = (), page: Page | None = None, at=None, data: dict | None = None) -> DataFrame:
        """(record). ``at`` is the time of the sort; each leaf of the condition has its own, or now."""
        return self._records(condition, self._at(at), data, order_by, page)

    def find_one(self, condition) -> int | None:
        rows = self.find(condition).limit(2).collect()
        if len(rows) > 1:
            raise write.DuplicateEntry(f"more than one record matches {condition!r}")
        return rows[0][0] if rows else None

    def explore(self, key: str, op: str, *values: Scalar, at=None) -> DataFrame:
        """(record, str, num): values of the key that match."""
        t = navigate.key_triples(self.store, key, self._at(at))
        return t.filter(Triple().compare(operator_of(op), list(values))).select("record", "str", "num")

    # projections
    def select(self, keys: list[str] | str | None = None, of=None, at=None, order_by: Iterable[Sort] = (), page: Page | None = None) -> DataFrame:
        """All values: (record, key, type, num, str, vid, added_at)."""
        keys = [keys] if isinstance(keys, str) else keys
        return read.project(self.store, keys, self._records(of, self._at(at), None, order_by, page), self._at(at))

    def get(self, keys: list[str] | str | None = None, of=None, at=None, order_by: Iterable[Sort] = (), page: Page | None = None) -> DataFrame:
        """The last added value of each field."""
        return read.latest(self.select(keys, of, at, order_by, page))

    def table(self, keys: list[str], of=None, at=None, single: bool = False) -> DataFrame:
        records = self._records(of, self._at(at))
        return read.wide(read.project(self.store, keys, records, self._at(at)), keys, records, single)

    def gather(self, key: str, record: int, at=None) -> DataFrame:
        return self.select(key, record, at)

    def browse(self, keys: str | list[str], at=None) -> DataFrame:
        return read.browse(self.store, keys, self._at(at))

    def describe(self, of=None, at=None) -> DataFrame:
        return read.describe(self.store, self._records(of), self._at(at))

    def verify(self, key: str, value: Scalar, record: int, at=None) -> bool:
        return read.verify(self.store, key, value, record, self._at(at))

    def ping(self, of) -> DataFrame:
        return read.ping(self.store, self._records(of))

    def inventory(self) -> DataFrame:
        return self.store.inventory()

    def holds(self, record: int) -> bool:
        return bool(self.store.inventory().filter(F.col("record") == record).limit(1).count())

    def jsonify(self, of=None, at=None, include_id: bool = False) -> DataFrame:
        return read.jsonify(self.store, self._records(of), self._at(at), include_id)

    def json_array(self, of=None, at=None, include_id: bool = False) -> str:
        """All objects of ``jsonify`` as one array, for results that the caller can hold."""
        return read.json_array(self.jsonify(of, at, include_id)).first()[0]

    def search(self, key: str, needle: str) -> DataFrame:
        """(record, matches), best first."""
        return search.ranked(self.store.triples([key]), needle).orderBy(F.desc("matches"), *order.unsigned(F.col("record")))

    # links
    def navigate(self, path: str, of=None, at=None) -> DataFrame:
        records = self._records(of)
        return navigate.navigate(self.store, path, self.store.inventory() if records is None else records, self._at(at))

    def trace(self, of=None, keys: list[str] | None = None, at=None) -> DataFrame:
        return navigate.trace(self.store, self._records(of), keys, self._at(at), skip_self=isinstance(of, int))

    # calculations
    def calculate(self, name: str, key: str, of=None, at=None) -> DataFrame:
        """(value). With records or a condition, over those only; the key may navigate."""
        t = navigate.key_triples(self.store, key, self._at(at), self._records(of))
        return calc.over(t, name, records=of is not None and not isinstance(of, int))

    def calculate_by_record(self, name: str, key: str, at=None) -> DataFrame:
        return calc.by_record(navigate.key_triples(self.store, key, self._at(at)), name)

    def statistics(self, keys: list[str] | None = None, at=None) -> DataFrame:
        return calc.statistics(self.store.triples(keys, self._at(at)))

    # history
    def _history(self, key: str | None, record: int | None) -> DataFrame:
        log = self.store.revisions(None if key is None else [key])
        return log if record is None else log.filter(F.col("record") == record)

    def review(self, record: int | None = None, key: str | None = None, start=None, end=None) -> DataFrame:
        return temporal.review(self._history(key, record), self._at(start), self._at(end))

    audit = review

    def changes(self, record: int | None = None, key: str | None = None, start=None, end=None) -> DataFrame:
        """(record, version, changes): ``review`` by version, in words."""
        return temporal.described(self._history(key, record), self._at(start), self._at(end))

    def chronologize(self, key: str, record: int | None = None, start=None, end=None) -> DataFrame:
        return temporal.chronologize(self._history(key, record), self._at(start), self._at(end))

    def diff(self, start, end=None, key: str | None = None, record: int | None = None) -> DataFrame:
        return temporal.diff(self._history(key, record), self._at(start), self._at(end))

    def time(self, phrase: str | None = None) -> int:
        return to_micros(phrase or "now", self.clock)


class Conflict(RuntimeError):
    """Another writer has published the commit's number; refresh and try again."""


@dataclass(frozen=True)
class Manifest:
    """What a commit's pointer says: all folders of revisions, the snapshot of what is live with the folders since, the last
    version, and the first record id that was never used."""

    folders: list[str] = field(default_factory=list)
    live: str | None = None
    since: int = 0
    tail: list[str] = field(default_factory=list)
    version: int = 0
    fresh: int = 0


#: Statements of a transaction are this far apart in ``seq``, so that their order is that of the log.
_STATEMENT = 1 << 32
#: Record ids beyond this are a caller's own and do not move the ids of new records.
_OWN_IDS = 1 << 62


class Ledger(Reader):
    """An environment: a folder of committed revisions, read as of a version, written by one writer at a time.

    A commit writes its rows into a folder of its own, then a pointer file with a temporary name, and gives the pointer the next
    number as its name in one step that fails if the name is taken: the writer that comes second has lost, publishes nothing and
    must read again. A pointer holds the whole list of folders, so that readers open the last one only, and a crash between two
    steps leaves what no pointer names."""

    def __init__(self, spark: SparkSession, root: str, environment: str = "default", clock: Clock = now, version: int | None = None):
        self.root = f"{root.rstrip('/')}/{environment}"
        self.environment = environment
        self.staged: list[tuple[str, DataFrame]] | None = None
        super().__init__(None, spark, clock)
        self.refresh(version)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def commits(self) -> list[int]:
        """Numbers of the pointers that stand."""
        fs, path = self._fs()
        log = path(f"{self.root}/_log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))

    def _read(self, number: int) -> Manifest:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/_log/{number:012d}"))
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _claim(self, number: int, manifest: Manifest) -> None:
        """Publishes a pointer, or raises Conflict if its number is taken."""
        fs, path = self._fs()
        log = f"{self.root}/_log"
        fs.mkdirs(path(log))
        temporary, final = path(f"{log}/.{uuid.uuid4().hex}"), path(f"{log}/{number:012d}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(temporary.toUri().getPath(), final.toUri().getPath())  # a rename would replace what is there
            else:
                jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
                options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, final, options)
        except FileExistsError:
            raise Conflict("another writer has committed; refresh and try again") from None
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict("another writer has committed; refresh and try again") from None
            raise
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    def refresh(self, version: int | None = None) -> None:
        commits = self.commits()
        self.number = commits[-1] if commits else 0
        self.manifest = self._read(self.number) if commits else Manifest()
        m = self.manifest
        if version is not None:
            self.store = LogStore(self._folders(m.folders).filter(F.col("version") <= version))
        elif m.live is None:
            self.store = LogStore(self._folders(m.folders))
        else:
            self.store = LogStore(self._folders(m.folders), self._folders([m.live]), self._folders(m.tail) if m.tail else None, m.since)
        self.version, self.fresh = m.version, max(m.fresh, getattr(self, "fresh", 0))

    def _folders(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/data/{f}" for f in folders]
        return self.spark.read.schema(REVISIONS).parquet(*paths) if paths else self.spark.createDataFrame([], REVISIONS)

    def next_version(self) -> int:
        """Later than every version of the log and of what is staged."""
        return max(to_micros("now", self.clock), self.version + 1)

    def append(self, revisions: DataFrame) -> bool:
        """Publishes revisions (sorted by key, so that scans of a key skip most row groups); staged ones wait for commit."""
        if self.staged is not None:
            # statements are told apart by version until the commit gives all of them one
            version, path = self.next_version(), f"{self.root}/_staged/{uuid.uuid4().hex}"
            # written, so that the next statement reads rows and not the plans of all statements before
            revisions.withColumn("version", F.lit(version).cast("long")).select(*COLUMNS).write.parquet(path)
            placed = self.spark.read.schema(REVISIONS).parquet(path)
            self.staged.append((path, placed))
            self.store, self.version = self.store.plus(placed), version
            return True
        return self._publish(revisions)

    def _publish(self, revisions: DataFrame) -> bool:
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/{folder}"
        revisions.select(*COLUMNS).sortWithinPartitions("key", "num", "record").write.parquet(path)
        # ids that callers or imports chose count as used too
        version, used = self.spark.read.schema(REVISIONS).parquet(path).agg(F.max("version"), F.max(F.when(F.col("record") < _OWN_IDS, F.col("record")))).first()
        m = self.manifest
        tail = [*m.tail, folder] if m.live is not None else []
        try:
            self._claim(self.number + 1, replace(m, folders=[*m.folders, folder], tail=tail, version=max(m.version, version or 0), fresh=max(self.fresh, (used or 0) + 1)))
        except Conflict:
            fs, at = self._fs()
            fs.delete(at(path), True)
            raise
        self.refresh()
        return True

    # transactions
    def stage(self) -> None:
        if self.staged is not None:
            raise write.InvalidWrite("a transaction is open")
        self.staged = []

    def commit(self) -> bool:
        """Publishes all staged statements as one version; ``seq`` keeps their order, so that the log folds to what was staged."""
        staged, self.staged = self.staged or [], None
        if not staged:
            return True
        version, out = self.next_version(), None
        for i, (_, rows) in enumerate(staged):
            placed = rows.withColumn("seq", F.col("seq") + i * _STATEMENT).withColumn("version", F.lit(version).cast("long"))
            out = placed if out is None else out.unionByName(placed)
        try:
            return self._publish(out)
        except Conflict:
            self.refresh()
            raise
        finally:
            self._forget(staged)

    def abort(self) -> None:
        staged, self.staged = self.staged or [], None
        self._forget(staged)
        self.refresh()

    def _forget(self, staged: list[tuple[str, DataFrame]]) -> None:
        fs, path = self._fs()
        for folder, _ in staged:
            fs.delete(path(folder), True)

    def compact(self) -> None:
        """One folder, ordered by key and record, in place of all, and a snapshot of what is live; the history stays.

        One pointer replaces the list, so that a crash before it changes nothing and one after it leaves unnamed folders only."""
        if self.staged is not None:
            raise write.InvalidWrite("a transaction is open")
        whole, live = uuid.uuid4().hex, uuid.uuid4().hex
        for rows, folder in ((self.store.log, whole), (snapshot(self.store.now()), live)):
            rows.repartitionByRange("key", "record").sortWithinPartitions("key", "record").write.parquet(f"{self.root}/data/{folder}")
        m = self.manifest
        self._claim(self.number + 1, replace(m, folders=[whole], live=live, since=m.version, tail=[]))
        self.refresh()

    def vacuum(self) -> int:
        """Deletes folders and pointers that the last pointer does not need; for a time when nobody reads or writes. How many."""
        fs, path = self._fs()
        keep = {*self.manifest.folders, *self.manifest.tail, self.manifest.live}
        fs.delete(path(f"{self.root}/_staged"), True)
        gone = [s.getPath() for s in fs.listStatus(path(f"{self.root}/data")) if s.getPath().getName() not in keep]
        gone += [path(f"{self.root}/_log/{n:012d}") for n in self.commits() if n < self.number]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    # writes
    def _write(self, rows: list[tuple[str, str, Scalar, int]]) -> DataFrame | None:
        """The revisions that took effect, or None."""
        wanted = write.intents(self.spark, rows, self.next_version())
        done = write.effective(self.store.now([r[1] for r in rows]), wanted)
        if not done.limit(1).count():
            return None
        self.append(done)
        return done

    def new_record(self, count: int = 1) -> int:
        """The first of ``count`` record ids that no record has had and no later call gets."""
        first = max(to_micros("now", self.clock), self.version + 1, self.fresh)
        self.fresh = first + count
        return first

    def _each(self, action: str, key: str, value: Scalar, record: int | Iterable[int]) -> bool | dict[int, bool]:
        """Whether the write took effect: of one record, or of each of several."""
        records = [record] if isinstance(record, int) else list(record)
        wanted = write.intents(self.spark, [(action, key, value, r) for r in records], self.next_version())
        done = write.effective(self.store.now([key]), wanted)
        took = {r[0] for r in done.select("record").collect()}  # at most the records that the caller listed
        if took:
            self.append(done)
        return record in took if isinstance(record, int) else {r: r in took for r in records}

    def add(self, key: str, value: Scalar, record: int | Iterable[int] | None = None) -> int | bool | dict[int, bool]:
        """Without a record: the id of a new one."""
        if record is None:
            fresh = self.new_record()
            self._write([("ADD", key, value, fresh)])
            return fresh
        return self._each("ADD", key, value, record)

    def remove(self, key: str, value: Scalar, record: int | Iterable[int]) -> bool | dict[int, bool]:
        return self._each("REMOVE", key, value, record)

    def link(self, key: str, source: int, target: int | Iterable[int]) -> bool:
        """Whether any of the links is new."""
        targets = [target] if isinstance(target, int) else list(target)
        return self._write([("ADD", key, Link(t), source) for t in targets]) is not None

    def unlink(self, key: str, source: int, target: int | Iterable[int]) -> bool:
        targets = [target] if isinstance(target, int) else list(target)
        return self._write([("REMOVE", key, Link(t), source) for t in targets]) is not None

    def _target(self, rows: list[tuple[str, Scalar, int]]) -> DataFrame:
        return write.intents(self.spark, [("ADD", k, v, r) for k, v, r in rows], 0).select("key", "record", "type", "num", "str", "vid")

    def set(self, key: str, value: Scalar, record: int | Iterable[int] | None = None) -> bool | int:
        """Without a record: the id of a new one."""
        if record is None:
            return self.add(key, value)
        records = [record] if isinstance(record, int) else list(record)
        return self.append(write.set_values(self.store.now([key]), self._target([(key, value, r) for r in records]), self.next_version()))

    verify_or_set = set

    def reconcile(self, key: str, record: int, values: Iterable[Scalar]) -> bool:
        values = list(values)
        if not values:
            return self.clear([key], record)
        return self.append(write.set_values(self.store.now([key]), self._target([(key, v, record) for v in values]), self.next_version()))

    def clear(self, keys: list[str] | None, of) -> bool:
        return self.append(write.clear(self.store.now(keys), self._records(of), keys, self.next_version()))

    def verify_and_swap(self, key: str, expected: Scalar, record: int, value: Scalar) -> bool:
        done = write.verify_and_swap(self.store.now([key]), key, expected, record, value, self.next_version())
        found = done.limit(1).count() > 0
        if found:
            self.append(done)
        return found

    def find_or_add(self, key: str, value: Scalar) -> int:
        found = self.find_one(ccl.where(key).op("=", value))
        return found if found is not None else self.add(key, value)

    def find_or_insert(self, condition, document: str | dict) -> int:
        found = self.find_one(condition)
        return found if found is not None else self.insert(document)[0]

    def insert(self, document: str | dict | list, into: int | Iterable[int] | None = None) -> list[int] | bool | dict[int, bool]:
        """JSON objects as records: arrays are several values, nulls are left out, nested objects are refused. ``$id$`` names a
        record; a text ``@condition@`` links to every record that the condition finds. Everything is one commit.

        Of new records the ids. ``into`` records that exist: whether the object went in; it does as a whole or, if one of its
        values is there already, not at all. Large inputs: sources.files."""
        objects = json.loads(document) if isinstance(document, str) else document
        objects = objects if isinstance(objects, list) else [objects]
        if into is not None:
            targets = [into] if isinstance(into, int) else list(into)
            rows, links = self._rows_of([(o, r) for r in targets for o in objects])
            blocked = {r for r in targets if any(o.get("$id$") not in (None, r) for o in objects)}
            wanted = self._intended(rows, links)
            live = fold(self.store.now()).select("key", "record", "vid")
            blocked |= {r[0] for r in wanted.join(live, ["key", "record", "vid"], "left_semi").select("record").distinct().collect()}  # of ``targets``
            free = [r for r in targets if r not in blocked]
            if free:
                self.append(write.effective(self.store.now(), wanted.filter(F.col("record").isin(*free))))
            return into in free if isinstance(into, int) else {r: r in free for r in targets}
        first = self.new_record(len(objects))
        used = [int(o["$id$"]) if o.get("$id$") is not None else first + i for i, o in enumerate(objects)]
        rows, links = self._rows_of(list(zip(objects, used, strict=True)))
        done = write.effective(self.store.now(), self._intended(rows, links))
        if done.limit(1).count():
            self.append(done)
        return used

    @staticmethod
    def _rows_of(pairs: list[tuple[dict, int]]) -> tuple[list[tuple], list[tuple[str, int, str]]]:
        """(action, key, value, record) rows, and (key, record, condition) of links still to be resolved."""
        rows, links = [], []
        for o, r in pairs:
            for key, value in o.items():
                for v in [] if key == "$id$" else value if isinstance(value, list) else [value]:
                    if isinstance(v, dict | list):
                        raise write.InvalidWrite("nested values cannot be stored")
                    if v is not None:
                        v = json_value(v)
                        links.append((key, r, v.condition)) if isinstance(v, ResolvableLink) else rows.append(("ADD", key, v, r))
        return rows, links

    def _intended(self, rows: list[tuple], links: list[tuple[str, int, str]]) -> DataFrame:
        """All as ADDs; the sources of one condition and key meet what it finds, these rows included, by the condition's number."""
        version = self.next_version()
        out = write.intents(self.spark, rows, version)
        seen = Reader(self.store.plus(out), self.spark, self.clock)
        for n, (key, condition) in enumerate(dict.fromkeys((k, c) for k, _, c in links)):
            write.check(key, Link(0), None)
            sources = self.ids([r for k, r, c in links if (k, c) == (key, condition)]).withColumn("number", F.lit(n))
            out = out.unionByName(write.links_to(sources, key, seen.find(condition).withColumn("number", F.lit(n)), version, len(rows)))
        return out

    def revert(self, keys: list[str], of, to) -> bool:
        log = self.store.revisions(keys).join(self._records(of), "record", "left_semi")
        return self.append(temporal.revert(log, self._at(to), self.next_version()))

    def consolidate(self, into: int, *others: int) -> bool:
        return self.append(write.consolidate(self.store.now(), into, list(others), self.next_version()))

    def import_revisions(self, revisions: DataFrame) -> bool:
        return self.append(write.effective(self.store.now(), revisions))

    def live(self, at=None) -> DataFrame:
        return self.store.triples(None, self._at(at))


def json_value(v):
    """A JSON value; a text is a string unless it writes a link, tag, timestamp or a number that ends in D."""
    if not isinstance(v, str):
        return v
    if v[:1] in "@`|" or re.fullmatch(r"[+-]?\d+(\.\d+)?D", v):
        return infer(v)
    return v


class Extensions:
    """Named callables that get the reader and their arguments: the place of plugins."""

    def __init__(self):
        self.of: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, **methods: Callable) -> None:
        self.of.setdefault(name, {}).update(methods)

    def invoke(self, name: str, method: str, reader: Reader, *args):
        try:
            call = self.of[name][method]
        except KeyError:
            raise LookupError(f"no extension {name}.{method}") from None
        return call(reader, *args)

"""The clean star schema: staging -> standardised -> deduplicated.

The stage boundaries are those of the source workflow (copy into working
tables, fix them, audit them, remove duplicates, analyse):

1. the *standardised* tables (account filter, label fixes, key renames), read
   by the NULL / key / duplicate audits;
2. the *deduplicated* tables, read by every analytic query;
3. the registration x dog aggregate per (key, suburb), read by the geography
   queries instead of re-joining.

Each table is written as Parquet when a query first needs it, so a dog count
writes the dog table and nothing else, and later queries start from a plain
scan. A table is written to a folder of its own and renamed when its job has
finished: readers and other sessions see whole tables only.

A folder holds the tables of one *snapshot* of the input. The caller names the
snapshot (the same name means the same input, so finished tables are used
again, by later sessions too) or lets every call write a new one; a rerun on
changed input never meets old tables."""

from __future__ import annotations

import contextlib
import datetime as _dt
import hashlib
import inspect
import threading
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from regilens.functions import constants
from regilens.operators import audit
from regilens.operators import cleaning as C
from regilens.operators.analytics import registration_geo
from regilens.operators.calendar import calendar_cube
from regilens.operators.dated import YEAR, by_date
from regilens.session import checkpoint_root, hadoop_path, path_join
from regilens.sources import fixtures, schemas
from regilens.sources.fixtures import load_stages, loose_spelling
from regilens.sources.staging import collate_stage


# written table -> the star's attribute
TABLES = {"DimDog_std": "dog_std", "FactRegistration_std": "registration_std", "FactTransaction_std": "transaction_std",
          "FactRegistration": "registration", "FactTransaction": "transaction"}


SHUFFLE_BYTES = 8 << 20  # of the files that a written table reads, per shuffle partition
_SETTING = threading.Lock()


@dataclass(frozen=True)
class Star:
    dog_stage: DataFrame
    registration_stage: DataFrame
    transaction_stage: DataFrame
    # after account filter, label fixes and key renames; before dedup
    dog_std: DataFrame
    registration_std: DataFrame
    transaction_std: DataFrame
    # deduplicated (clean) tables
    dog: DataFrame
    registration: DataFrame
    transaction: DataFrame
    # (Registration_Key, Kept_At_Suburb, c): registration x dog rows per key and
    # suburb, shared by the geography queries; computed when not supplied
    registration_geo: DataFrame | None = None

    @property
    def geo_pairs(self) -> DataFrame:
        return self.registration_geo if self.registration_geo is not None \
            else registration_geo(self.registration, self.dog)

    @property
    def calendar(self) -> DataFrame:
        return calendar_cube(self.registration, self.transaction)

    @property
    def registration_dated(self) -> DataFrame:
        return by_date(self.registration, "Registration_From")

    @property
    def transaction_dated(self) -> DataFrame:
        return by_date(self.transaction, "Transaction_Date")

    def audit(self, table: str, as_of: _dt.date = constants.AS_OF) -> DataFrame:
        return audit.scanned(getattr(self, TABLES[table]), audit.figures(table, as_of))


def build_star(stages: dict[str, DataFrame], collated: bool = False) -> Star:
    """Lazy clean path from the three staging tables. With ``collated``, labels
    that differ in case or trailing blanks only are equal all the way (see
    :func:`regilens.sources.staging.collate_stage`)."""
    if collated:
        stages = {t: collate_stage(df, t) for t, df in stages.items()}
    dog_stage, reg_stage, txn_stage = (stages["Dog_Stage"], stages["Dog_Registration_Stage"],
                                       stages["Dog_Transaction_Stage"])
    dog_std = C.standardise_dog(dog_stage)
    reg_std = C.standardise_registration(reg_stage)
    txn_std = C.standardise_transaction(txn_stage)
    return Star(dog_stage, reg_stage, txn_stage, dog_std, reg_std, txn_std,
                C.dedup_dog(dog_std), C.dedup_registration(reg_std), C.dedup_transaction(txn_std))


def _complete(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path_join(path, "_SUCCESS"))
    return fs.exists(p)


@contextlib.contextmanager
def _shuffles_by_size(spark: SparkSession, df: DataFrame):
    """While it lasts, shuffles have a partition for each :data:`SHUFFLE_BYTES`
    of the files that ``df`` reads, if the session's number is smaller: the rows
    that a task sorts then fit in memory whatever the size of the input."""
    sizes = [fs.getFileStatus(p).getLen() for fs, p in (hadoop_path(spark, f) for f in df.inputFiles())]
    with _SETTING:  # one at a time, or another's number would be taken for the session's
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), -(-sum(sizes) // SHUFFLE_BYTES))))
        try:
            yield
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def write_table(spark: SparkSession, df: DataFrame, path: str, figures: dict | None = None, figures_path: str | None = None,
                partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The finished table at ``path``, written first if there is none. Two
    sessions that write it at once each write their own copy; the first to
    finish gives the table. ``figures`` are counted by the writing job and
    stored at ``figures_path`` before the table appears."""
    if not _complete(spark, path):
        copy = f"{path}.{uuid.uuid4().hex}"
        if figures:
            df, seen = audit.observed(df, figures)
        with _shuffles_by_size(spark, df):
            df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(copy)
        if figures:
            write_table(spark, audit.audit_rows(spark, figures, seen.get), figures_path)
        fs, to = hadoop_path(spark, path)
        _, made = hadoop_path(spark, copy)
        if _complete(spark, path) or not fs.rename(made, to) or not _complete(spark, path):
            return spark.read.parquet(copy if fs.exists(made) else path)
    return spark.read.parquet(path)


class StagedStar:
    """A star whose tables are written under ``folder`` when first needed;
    the same attributes as :class:`Star`."""

    def __init__(self, spark: SparkSession, plan: Star, folder: str, as_of: _dt.date | None = None):
        self._spark, self._plan, self._folder = spark, plan, folder
        self._as_of = as_of or _dt.date.today()
        self.dog_stage, self.registration_stage, self.transaction_stage = plan.dog_stage, plan.registration_stage, plan.transaction_stage

    def _audit_path(self, name: str) -> str:
        return path_join(self._folder, f"{name}_audit_{self._as_of}")

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        return write_table(self._spark, df, path_join(self._folder, name), audit.figures(name, self._as_of), self._audit_path(name))

    def audit(self, table: str) -> DataFrame:
        """The figures counted when ``table`` was written (it is, if need be). A
        table that another run date wrote is scanned once."""
        df = getattr(self, TABLES[table])
        return write_table(self._spark, audit.scanned(df, audit.figures(table, self._as_of)), self._audit_path(table))

    def _std(self, attribute: str) -> DataFrame:
        """The written standardised table if an audit has asked for it, else
        its plan: cleaning alone does not write the table twice."""
        return self.__dict__.get(attribute, getattr(self._plan, attribute))

    @cached_property
    def dog_std(self) -> DataFrame:
        return self._put("DimDog_std", self._plan.dog_std)

    @cached_property
    def registration_std(self) -> DataFrame:
        return self._put("FactRegistration_std", self._plan.registration_std)

    @cached_property
    def transaction_std(self) -> DataFrame:
        return self._put("FactTransaction_std", self._plan.transaction_std)

    @cached_property
    def dog(self) -> DataFrame:
        return self._put("DimDog", C.dedup_dog(self._std("dog_std")))

    # Each clean fact file is sorted by its main date: Parquet row-group
    # min/max statistics then let the pushed date-range filters of the trend
    # and outlier queries skip whole row groups. Key order would buy nothing --
    # every key-based query aggregates through a shuffle anyway.
    @cached_property
    def registration(self) -> DataFrame:
        return self._put("FactRegistration", C.dedup_registration(self._std("registration_std"))
                         .sortWithinPartitions("Registration_From"))

    @cached_property
    def transaction(self) -> DataFrame:
        return self._put("FactTransaction", C.dedup_transaction(self._std("transaction_std"))
                         .sortWithinPartitions("Transaction_Date"))

    @cached_property
    def registration_geo(self) -> DataFrame:
        return self._put("RegistrationGeo", registration_geo(self.registration, self.dog))

    @cached_property
    def calendar(self) -> DataFrame:
        return self._put("CalendarCube", calendar_cube(self.registration, self.transaction))

    # the facts once more, a folder per year and date ranges inside, for queries by date
    @cached_property
    def registration_dated(self) -> DataFrame:
        return write_table(self._spark, by_date(self.registration, "Registration_From"), path_join(self._folder, "FactRegistration_dated"), partition_by=(YEAR,))

    @cached_property
    def transaction_dated(self) -> DataFrame:
        return write_table(self._spark, by_date(self.transaction, "Transaction_Date"), path_join(self._folder, "FactTransaction_dated"), partition_by=(YEAR,))

    @property
    def geo_pairs(self) -> DataFrame:
        return self.registration_geo


def materialise(spark: SparkSession, star: Star, root: str, snapshot: str | None = None, as_of: _dt.date | None = None) -> StagedStar:
    """A star whose tables are written under ``root`` on first use. With
    ``snapshot`` (a name that identifies the input) finished tables of that
    name are used again; without one, every call writes new tables. ``as_of``
    (default: today) is the run date of the audit taken while writing."""
    return StagedStar(spark, star, path_join(root, snapshot or uuid.uuid4().hex), as_of)


def save_tables(star: Star | StagedStar, database: str | None = None, **options) -> dict[str, str]:
    """Save the clean tables under lasting names in the session's catalog
    (replacing what has these names) and return the names."""
    names = {}
    for table, df in (("DimDog", star.dog), ("FactRegistration", star.registration), ("FactTransaction", star.transaction)):
        names[table] = f"{database}.{table}" if database else table
        own = {k: path_join(v, table) if k == "path" else v for k, v in options.items()}
        df.write.mode("overwrite").options(**own).saveAsTable(names[table])
    return names


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files, and the code that derives
    the tables from them."""
    h = hashlib.sha1()
    for module in (C, audit, fixtures, schemas, constants):
        h.update(inspect.getsource(module).encode())
    for t in ("customer", "nation", "orders", "lineitem"):
        fs, p = hadoop_path(spark, path_join(sf_dir, f"{t}.parquet"))
        for f in (fs.globStatus(p) or []):
            for st in fs.listStatus(f.getPath()):
                h.update(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


_CACHE: dict[tuple, Star | StagedStar] = {}
_LOCK = threading.Lock()


def fixture_star(spark: SparkSession, sf_dir: str, materialised: bool = True, collated: bool = False) -> Star | StagedStar:
    """Star schema derived from the test tables in ``sf_dir``; with
    ``materialised`` its tables are written under the shared checkpoint folder
    when first needed, under a name that changes with the input. ``collated``
    takes labels in loose spelling (see :func:`fixtures.loose_spelling`) and a
    star that ignores case and trailing blanks."""
    key = (spark.sparkContext.applicationId, sf_dir, _fingerprint(spark, sf_dir), materialised, collated)
    with _LOCK:
        if key not in _CACHE:
            stages = load_stages(spark, sf_dir)
            star = build_star(loose_spelling(stages) if collated else stages, collated)
            _CACHE[key] = materialise(spark, star, path_join(checkpoint_root(spark), "regilens_star"), key[2] + ("-collated" if collated else ""),
                                      constants.AS_OF) if materialised else star
        return _CACHE[key]

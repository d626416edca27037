"""Randomised differential test: small random star schemas with repeated
keys, NULL keys, orphans, NULL suburbs and dirty text; every query that reads
only the clean tables runs through the Spark operators and through its
literal SQL in DuckDB, and the results must agree."""

import datetime as dt
import random
import re
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from oracle_harness import compare
from regilens.plans import catalog, oracle
from regilens.plans.star import Star
from regilens.sources.schemas import DOG_STAGE, REGISTRATION_STAGE, TRANSACTION_STAGE

CLEAN = {"dim_dog", "fact_registration", "fact_transaction"}
OTHER_CTES = {n for n, _ in oracle.PREFIX_CTES + oracle.COLLATED_CTES} - CLEAN


def _clean_only(name: str) -> bool:
    sql = oracle.body_sql(name)
    return not any(re.search(rf"\b{c}\b", sql) for c in OTHER_CTES)


NAMES = sorted(n for n in catalog.CATALOG if _clean_only(n))

TYPES = ["Late Payment Penalty Fee", "Prompt Payment", "Fenced Property Discount", "Neutered Discount",
         "Obedience Training Discount", "Permanent Identification Discount", "Fence Inspection Fee",
         "Registration Fee", "Perm Neut Obed"]
SUBURBS = ["A", "B", "C", "Rural Hamilton 1", "Tiny", None]
FEES = ["Standard", "Working Dog", "Selected Owner", None]


def _date(rng, lo=1995, hi=2030, null=0.1):
    if rng.random() < null:
        return None
    return dt.date(rng.randint(lo, hi), rng.randint(1, 12), rng.randint(1, 28))


def _pick(rng, xs, null=0.0):
    return None if rng.random() < null else rng.choice(xs)


def make_star(seed: int, hot: bool = False):
    """Random star; with ``hot`` a third of the dogs, registrations and
    transactions share one key (the skew the operators must survive)."""
    rng = random.Random(seed)
    dogs, regs, txns = [], [], []
    fids = iter(rng.sample(range(1, 10_000), 2_000))
    for _ in range(40):
        dogs.append((next(fids), _pick(rng, range(1, 16), 0.05), _pick(rng, SUBURBS), _pick(rng, ["3200", "3201"], .2),
                     _pick(rng, ["Hamilton"], .2), _date(rng, 2005, 2020), _pick(rng, "FM"),
                     f"Breed {rng.randint(0, 3)}", f"Colour {rng.randint(0, 2)}", _pick(rng, "YN"),
                     _pick(rng, FEES), _pick(rng, ["h1", "h2", "h3"])))
    for _ in range(80):
        regs.append((next(fids), _pick(rng, range(1, 26), 0.05), _pick(rng, range(1, 19), 0.05), _date(rng),
                     _date(rng), _pick(rng, "YN"), _date(rng, null=0.2),
                     Decimal(rng.choice([-10, 50, 120, 650])).quantize(Decimal("0.01")),
                     _pick(rng, ["1-URGENT", "2-HIGH"]), _pick(rng, FEES, 0.1),
                     _pick(rng, ["75.00", "N/A", "-5.00", "650.50", " 12.5 ", "1e3"], 0.2),
                     _pick(rng, ["h1", "h2", "h3"])))
    for _ in range(200):
        txns.append((next(fids), _pick(rng, range(1, 31), 0.08), "Animal Registration", _date(rng, 1990, 2030),
                     Decimal(rng.choice([-150, -20, 0, 60, 750])).quantize(Decimal("0.01")),
                     _pick(rng, TYPES), _pick(rng, ["h1", "h2"])))
    if hot:
        def heat(rows, idx):
            return [r[:idx] + (1,) + r[idx + 1:] if i % 3 == 0 else r for i, r in enumerate(rows)]
        dogs = heat(dogs, 1)
        regs = heat(heat(regs, 1), 2)
        txns = heat(txns, 1)
    return dogs, regs, txns


def _schema(st, rename=None):
    from pyspark.sql import types as T
    rename = rename or {}
    return T.StructType([T.StructField(rename.get(f.name, f.name), f.dataType, True) for f in st.fields])


@pytest.fixture(scope="module", params=[(7, False), (11, False), (23, False), (101, True)],
                ids=["seed7", "seed11", "seed23", "hotkey"])
def random_star(request, spark):
    dogs, regs, txns = make_star(*request.param)
    dog_s = _schema(DOG_STAGE)
    reg_s = _schema(REGISTRATION_STAGE, {"Registration_ID": "Registration_Key"})
    txn_s = _schema(TRANSACTION_STAGE, {"Account_Number": "Registration_Key"})
    dog = spark.createDataFrame(dogs, dog_s)
    reg = spark.createDataFrame(regs, reg_s)
    txn = spark.createDataFrame(txns, txn_s)
    con = duckdb.connect()
    for name, rows, st in (("dim_dog", dogs, dog_s), ("fact_registration", regs, reg_s),
                           ("fact_transaction", txns, txn_s)):
        pdf = pd.DataFrame(rows, columns=st.fieldNames())  # noqa: F841 (read by duckdb)
        types = {f.name: f.dataType.simpleString().replace("bigint", "BIGINT").replace("string", "VARCHAR")
                 .replace("date", "DATE").upper() for f in st.fields}
        cols = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
        con.execute(f"CREATE TABLE {name} AS SELECT {cols} FROM pdf")
    star = Star(dog, reg, txn, dog, reg, txn, dog, reg, txn)
    return star, con


@pytest.mark.parametrize("name", NAMES)
def test_random_star_matches_literal_sql(random_star, name):
    star, con = random_star
    df = catalog.CATALOG[name](star)
    assert compare(df, con, oracle.body_sql(name)) == []

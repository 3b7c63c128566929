"""Label and number expressions: everything a row needs is computed by built-in functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label families and the spellings that belong to them.
FAMILIES = ("BENIGN", "DoS", "DDoS", "PortScan", "Bot", "Web Attack", "Brute Force", "Infiltration", "Heartbleed")
EXACT = {
    "benign": "BENIGN",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "ddos": "DDoS",
    "portscan": "PortScan",
    "bot": "Bot",
    "web attack brute force": "Web Attack",
    "web attack xss": "Web Attack",
    "web attack sql injection": "Web Attack",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "infiltration": "Infiltration",
    "heartbleed": "Heartbleed",
}
PREFIXES = (
    ("dos ", "DoS"),
    ("ddos", "DDoS"),
    ("web attack", "Web Attack"),
    ("portscan", "PortScan"),
    ("infiltration", "Infiltration"),
    ("heartbleed", "Heartbleed"),
    ("bot", "Bot"),
    ("ftp-patator", "Brute Force"),
    ("ssh-patator", "Brute Force"),
    ("brute force", "Brute Force"),
)
ALIASES = {
    "benign": "Benign",
    "ftp-bruteforce": "FTP-BruteForce",
    "ssh-bruteforce": "SSH-Bruteforce",
    "dos attacks-goldeneye": "DoS attacks-GoldenEye",
    "dos attacks-slowloris": "DoS attacks-Slowloris",
    "dos attacks-slowhttptest": "DoS attacks-SlowHTTPTest",
    "dos attacks-hulk": "DoS attacks-Hulk",
    "ddos attacks-loic-http": "DDoS attacks-LOIC-HTTP",
    "ddos attack-hoic": "DDOS attack-HOIC",
    "ddos attack-loic-udp": "DDOS attack-LOIC-UDP",
    "brute force -web": "Brute Force -Web",
    "brute force -xss": "Brute Force -XSS",
    "sql injection": "SQL Injection",
    "infilteration": "Infilteration",
    "infiltration": "Infilteration",
    "bot": "Bot",
}
# Spellings of both corpora together; "brute force -web" and "-xss" don't go by their prefix.
COMBINED = {
    "benign": "BENIGN",
    "normal": "BENIGN",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "portscan": "PortScan",
    "bot": "Bot",
    "brute force -web": "Web Attack",
    "brute force -xss": "Web Attack",
    "sql injection": "Web Attack",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "ftp-bruteforce": "Brute Force",
    "ssh-bruteforce": "Brute Force",
    "infiltration": "Infiltration",
    "infilteration": "Infiltration",
    "heartbleed": "Heartbleed",
}
COMBINED_PREFIXES = {"dos attacks-": "DoS", "ddos": "DDoS", "web attack": "Web Attack", "brute force": "Brute Force"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_label(col: Column) -> Column:
    """Control and replacement characters become spaces, spaces collapse, lower case; null is ''.
    For text beyond Latin letters use normalize_labels, which decomposes compatibility forms too."""
    return F.coalesce(F.lower(collapse(F.regexp_replace(col, "[\\x00-\\x1f\\x7f-\\x9f\\ufffd]+", " "))), F.lit(""))


@F.arrow_udf(T.StringType())
def _decomposed(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKD", x) for x in raw.to_pylist()], pa.string())


def normalize_labels(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the normal form of col, decomposition included: Python sees the distinct labels only."""
    known = df.select(F.col(col).alias("_raw")).distinct().withColumn(out, normalize_label(_decomposed("_raw")))
    return df.join(known, F.col(col).eqNullSafe(F.col("_raw")), "left").drop("_raw")


def map_to_multiclass(key: Column) -> Column:
    """Family of a normalised label: exact spelling, then the prefixes in order, then Other."""
    out = F.when(_lookup(key, EXACT).isNotNull(), _lookup(key, EXACT))
    for prefix, family in PREFIXES:
        out = out.when(key.startswith(prefix), family)
    return out.otherwise("Other")


def map_to_binary(key: Column) -> Column:
    return F.when(key == "benign", "Normal").otherwise("Attack")


def normalize_raw_label(col: Column) -> Column:
    """Printable ASCII only, spaces collapsed, case kept; null is ''."""
    return F.coalesce(F.trim(F.regexp_replace(col, r"[^\x21-\x7E]+", " ")), F.lit(""))


def combined_family(col: Column) -> Column:
    """Family of a raw label of either corpus; null and unknown labels are Other. The key stands twice
    in the expression, so that a filter on the family, which computes it anew, costs little."""
    k = F.lower(normalize_raw_label(col))
    begin = F.regexp_extract(k, "^(" + "|".join(COMBINED_PREFIXES) + ")", 1)
    return F.coalesce(_lookup(k, COMBINED), _lookup(begin, COMBINED_PREFIXES), F.lit("Other"))


def alias_label(col: Column) -> Column:
    """Canonical spelling of a known label, else the trimmed original."""
    return F.coalesce(_lookup(F.lower(collapse(col)), ALIASES), F.trim(col))


def finite_or_null(col: Column) -> Column:
    """NaN and infinities become null: one sentinel for a missing number."""
    return F.when(F.abs(col) < float("inf"), col)  # NaN is above infinity


def to_number(col: Column) -> Column:
    """Null where text isn't a number."""
    return col.try_cast("double")

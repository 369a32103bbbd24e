"""Names: comparison without regard to letter case and Unicode composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def name_key_of(name: str | None) -> str | None:
    """Lower case, then canonical decomposition."""
    if name is None:
        return None
    return name.lower() if name.isascii() else unicodedata.normalize("NFD", unicodedata.normalize("NFD", name).lower())


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """``name_key_of`` over Arrow batches; Spark has no normalisation function."""
    return names.map(name_key_of, na_action="ignore")


@F.pandas_udf(StringType())
def nfd(texts: pd.Series) -> pd.Series:
    """Canonical decomposition, white space trimmed at both ends."""
    return texts.map(lambda s: unicodedata.normalize("NFD", s).strip(), na_action="ignore")


def with_name_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """Adds the key of each distinct name; the Python function sees every spelling once.

    For a table whose names repeat; where they are distinct already use ``name_key`` directly.
    """
    keys = df.select(name).where(F.col(name).isNotNull()).distinct().select(name, name_key(F.col(name)).alias(key))
    return df.join(keys, name, "left")


def blank_trimmed(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalized(text: str) -> str:
    """A query's text as it is compared: decomposed, trimmed."""
    return unicodedata.normalize("NFD", text).strip()


# Common words for packages.
PHRASE_ALIASES = {
    "node": ["nodejs"],
    "npm": ["nodejs"],
    "golang": ["go"],
    "rust": ["rustc"],
    "py3": ["python3"],
    "java": ["jdk"],
    "haskell": ["ghc"],
    "dotnet": ["dotnet-sdk"],
    "csharp": ["dotnet-sdk"],
    "postgres": ["postgresql"],
    "psql": ["postgresql"],
    "pg": ["postgresql"],
    "mongo": ["mongodb"],
    "sqlite3": ["sqlite"],
    "k8s": ["kubectl"],
    "kube": ["kubectl"],
    "gcloud": ["google-cloud-sdk"],
    "az": ["azure-cli"],
    "tofu": ["opentofu"],
    "nvim": ["neovim"],
    "rg": ["ripgrep"],
    "make": ["gnumake"],
    "ssh": ["openssh"],
    "gpg": ["gnupg"],
    "magick": ["imagemagick"],
    "mvn": ["maven"],
    "protoc": ["protobuf"],
    "pwsh": ["powershell"],
    "chrome": ["google-chrome"],
}

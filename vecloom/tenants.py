"""Settings of a tenant as one sealed file, their copies, and session keys with rotation."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidConfig
from .functions import crypt


@dataclass
class Tenant:
    name: str
    dimension: int
    clusters: int = 64
    lsh_seed: bytes = field(default_factory=lambda: os.urandom(16), repr=False)
    data_key: bytes = field(default_factory=crypt.new_key, repr=False)
    labels: dict[str, str] = field(default_factory=dict)

    def clone(self, **changes) -> Tenant:
        """A copy that shares nothing with this one."""
        return copy.deepcopy(Tenant(**asdict(self) | changes))

    def save(self, spark: SparkSession, path: str, key: bytes) -> None:
        """One sealed line; the tenant's name is authenticated with it. The name alone is readable."""
        text = json.dumps(asdict(self) | {"lsh_seed": self.lsh_seed.hex(), "data_key": self.data_key.hex()})
        row = spark.createDataFrame([(self.name, text)], "name string, body string")
        sealed = row.select("name", F.base64(crypt.encrypt(F.col("body").cast("binary"), key, F.col("name"))).alias("body"))
        sealed.coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: bytes) -> Tenant:
        row = spark.read.schema("name string, body string").json(path).select("name", crypt.decrypt(F.unbase64("body"), key, F.col("name")).cast("string").alias("body")).first()
        if row is None or row.body is None:
            raise InvalidConfig("no settings under this key")
        raw = json.loads(row.body)
        return cls(**raw | {"lsh_seed": bytes.fromhex(raw["lsh_seed"]), "data_key": bytes.fromhex(raw["data_key"])})


def session_key(bits: int = 63) -> int:
    """Random mask for signatures of so many bits."""
    return int.from_bytes(os.urandom(8), "little") & ((1 << bits) - 1)


def rotated(masked: Column, old: int, new: int) -> Column:
    """Signature under another session key, without unmasking it in between."""
    return masked.bitwiseXOR(F.lit(old ^ new))

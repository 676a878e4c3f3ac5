"""What a deployment may change, read from Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ronda import fixed_values as fv

PREFIX = "spark.ronda."


@dataclass(frozen=True)
class Settings:
    green_from: float = fv.GREEN_FROM
    amber_from: float = fv.AMBER_FROM
    history_days: int = fv.HISTORY_DAYS
    inbox_rows: int = fv.INBOX_ROWS
    # Suffix of the staff role ids; in lower case it is also the responder
    # type stored for staff answers.
    org_code: str = "ORG"

    @classmethod
    def from_spark(cls, spark: SparkSession) -> Settings:
        """Settings from ``spark.ronda.*``, e.g. ``spark.ronda.org_code``."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            value = spark.conf.get(PREFIX + name, None)
            if value is not None:
                found[name] = type(field.default)(value)
        return cls(**found)

    @property
    def inbox_staff_roles(self) -> tuple[str, ...]:
        return tuple(f"{rank}_{self.org_code}" for rank in fv.INBOX_STAFF_RANKS)

    @property
    def answer_staff_roles(self) -> tuple[str, ...]:
        return tuple(f"{rank}_{self.org_code}" for rank in fv.ANSWER_STAFF_RANKS)

    @property
    def staff_label(self) -> str:
        return self.org_code.lower()


DEFAULTS = Settings()

"""The extension point: a provider turns items and source tables into typed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.spec import STORAGE, FactSpec


class Provider:
    """Subclass, declare the facts, and give ``compute``.

    ``compute`` returns (item_id, status, reason, input_fp) and one struct column per
    namespace. A NULL field was not emitted, so a former value survives the merge.
    """

    id: str = ""
    facts: tuple[FactSpec, ...] = ()
    depends_on: tuple[str, ...] = ()
    # Raise it when the meaning of the output changes: all earlier results become stale.
    schema_version: int = 1
    # None: facts stay valid until the fingerprint changes.
    max_age_s: int | None = None
    # The fingerprint is that of the item's file.
    file_fingerprinted: bool = False
    applies_to: tuple[str, ...] = ("movie",)

    def selector(self) -> Column:
        """Coarse filter on items."""
        return F.lit(True)

    def ineligible(self) -> Column:
        """Why an item cannot be computed; NULL when it can."""
        return F.lit(None).cast("string")

    def fingerprint(self) -> Column:
        """Identity of the inputs; NULL when only age tells."""
        return F.lit(None).cast("string")

    def compute(self, items: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def vocabulary(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Known values per fact key, as frames with the column ``value``."""
        return {}

    # ── for compute ───────────────────────────────────────────────────────────

    def results(self, frame: DataFrame, made: dict[str, Column], status: Column | None = None,
                reason: Column | None = None) -> DataFrame:
        """Fold fact columns into namespace structs; only status ``ok`` carries facts.

        The condition is on every field and not on the struct, so that Spark can drop the
        fields a reader does not ask for, with all they are made of.
        """
        unknown = set(made) - {s.key for s in self.facts}
        if unknown:
            raise ValueError(f"{self.id} does not declare {sorted(unknown)}")
        done = None
        if status is not None:
            frame = frame.withColumn("_status", status)
            done = F.col("_status") == "ok"
        spaces: dict[str, list[Column]] = {}
        for spec in self.facts:
            value = made.get(spec.key, F.lit(None))
            if done is not None:
                value = F.when(done, value)
            spaces.setdefault(spec.namespace, []).append(
                value.cast(STORAGE[spec.type]).alias(spec.key.partition(".")[2]))
        nothing = F.lit(None).cast("string")
        return frame.select(
            "item_id", (F.lit("ok") if done is None else F.col("_status")).alias("status"),
            (nothing if reason is None else F.when(~done, reason)).alias("reason"),
            (F.col("input_fp") if "input_fp" in frame.columns else nothing).alias("input_fp"),
            *[F.struct(*fields).alias(name) for name, fields in spaces.items()],
        )

"""A working session: a store, a scene catalog with its reference date, and fan-out over several sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.operators import pairs, params
from fringework.sources import catalog
from fringework.sources.store import Store


class Session:
    """Scenes of an area in a folder."""

    def __init__(self, spark: SparkSession, folder: str, drop_if_exists: bool = False):
        self.spark, self.store = spark, Store(spark, folder)
        fs, p = self.store._fs(folder)
        if fs.exists(p):
            if not drop_if_exists:
                raise FileExistsError(folder)
            fs.delete(p, True)
        fs.mkdirs(p)
        self.scenes: DataFrame | None = None
        self.reference: str | None = None
        self.parameters: DataFrame | None = None

    def __repr__(self) -> str:
        return f"Session({self.store.folder!r}, reference {self.reference})"

    def to_dataframe(self) -> DataFrame:
        return self.scenes

    def set_scenes(self, scenes: DataFrame) -> Session:
        """The catalog must have rows, and an orbit file for each; the first date becomes the reference."""
        n, bad, first = scenes.agg(F.count("*"), F.sum(F.col("orbitpath").isNull().cast("int")), F.min("date")).first()
        if not n:
            raise ValueError("the catalog is empty")
        if bad:
            raise ValueError(f"{bad} scenes have no orbit file")
        self.scenes, self.reference = scenes, str(first)
        return self

    def set_reference(self, date: str | None) -> Session:
        if date is not None:
            if self.scenes.filter(F.col("date") == date).isEmpty():
                raise ValueError(f"no scene of {date}")
            self.reference = date
        return self

    def get_reference(self, subswath: int | None = None) -> DataFrame:
        return catalog.reference(self.scenes, self.reference, subswath)

    def get_repeat(self, subswath: int | None = None, date: str | None = None) -> DataFrame:
        out = catalog.repeats(self.scenes, self.reference, subswath)
        return out if date is None else out.filter(F.col("date") == date)

    def get_subswaths(self) -> list[int]:
        return [r.subswath for r in catalog.subswaths(self.scenes).collect()]

    def get_subswath(self, subswath: int | None = None) -> int:
        """A subswath of the catalog; of merged ones the first digit."""
        known = self.get_subswaths()
        if subswath is None:
            return int(str(known[0])[0])
        if subswath not in known and subswath not in {int(d) for k in known for d in str(k)}:
            raise ValueError(f"no subswath {subswath}")
        return subswath

    def get_pairs(self, days: int | None = None, meters: float | None = None, invert: bool = False) -> DataFrame:
        return pairs.make_pairs(self.scenes, days, meters, invert)

    def params_of(self, date: str | None = None, subswath: int | None = None) -> DataFrame:
        date = date or self.reference
        return self.parameters.filter((F.col("date") == date) & (F.col("subswath") == self.get_subswath(subswath)))

    def params_merged(self, date: str | None = None) -> DataFrame:
        """Parameters of a date patched with the extent of its merged subswaths."""
        date = date or self.reference
        where = params.stitching(self.parameters).groupBy("date").agg(F.first("maxy").alias("maxy"), F.first("maxx").alias("maxx"), F.first("minh").alias("minh"))
        first = self.parameters.filter(F.col("date") == date).groupBy("date").agg(F.min_by("params", "subswath").alias("params"))
        return first.join(where, "date").select("date", params.fix_merged(F.col("params"), F.col("maxy"), F.col("maxx"), F.col("minh")).alias("params"))

    # state

    def dump(self) -> None:
        self.store.save_cube(self.scenes, "_scenes")
        self.store.write_json("_session", {"reference": self.reference})

    @classmethod
    def restore(cls, spark: SparkSession, folder: str) -> Session:
        out = cls.__new__(cls)
        out.spark, out.store, out.parameters = spark, Store(spark, folder), None
        out.scenes = out.store.open_cube("_scenes")
        out.reference = out.store.read_json("_session")["reference"]
        return out

    def backup(self, folder: str, names: list[str] | None = None, copy: bool = True) -> None:
        """The catalog, the settings and the named tables in another folder."""
        self.dump()
        other = Store(self.spark, folder)
        self.store.copy_to(other, ["_scenes", *(names or [])], move=False)
        other.write_json("_session", {"reference": self.reference})
        if not copy:
            for n in names or []:
                self.store.delete_cube(n)


class Fan:
    """Several sessions that take the same call; results come as a list."""

    def __init__(self, *sessions):
        self.sessions, self.context = sessions, {}

    def __enter__(self) -> Fan:
        return self

    def __exit__(self, *_) -> None:
        self.context = {}

    def set_context(self, **values) -> Fan:
        """A value for each session under each name; calls get them as keyword arguments."""
        for k, v in values.items():
            if len(v) != len(self.sessions):
                raise ValueError(f"{k} has {len(v)} values for {len(self.sessions)} sessions")
        self.context = values
        return self

    def _own(self, i: int, more: dict) -> dict:
        return more | {k: v[i] for k, v in self.context.items()}

    def __getattr__(self, name: str):
        def call(*args, **more):
            return [getattr(s, name)(*args, **self._own(i, more)) for i, s in enumerate(self.sessions)]

        if name.startswith("_") or not all(hasattr(s, name) for s in self.sessions):
            raise AttributeError(name)
        if not all(callable(getattr(s, name)) for s in self.sessions):
            return [getattr(s, name) for s in self.sessions]
        return call

    def run_callable(self, func: Callable) -> list:
        return [func(s, **self._own(i, {})) for i, s in enumerate(self.sessions)]

    def run_method(self, name: str, **per_session) -> list:
        out = []
        for i, s in enumerate(self.sessions):
            if not hasattr(s, name):
                raise AttributeError(name)
            out.append(getattr(s, name)(**self._own(i, {k: v[i] for k, v in per_session.items()})))
        return out

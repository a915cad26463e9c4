"""The whole colony analysis as one lazy plan per stage: readings to events, kept readings, features, scores and sister comparison."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from combline.config import Thresholds
from combline.operators import features, quality, regions, scoring, steps
from combline.operators.spatial import near_classes
from combline.session import written


@dataclass(frozen=True)
class Analysis:
    """readings in the shape of readings_of, weather, sites (hive_id, latitude, longitude). What two stages read is written once."""

    readings: DataFrame
    weather: DataFrame
    sites: DataFrame
    cfg: Thresholds
    #: all readings, by which silence is measured, if readings are those of a window
    history: DataFrame | None = None

    @cached_property
    def ordered(self) -> DataFrame:
        """The readings, put in order once: what each says against those before it, and a seq that is a long."""
        return written(quality.prepared(self.readings, self.cfg), "prepared")

    @cached_property
    def digest(self) -> DataFrame:
        """What the stages up to the features need of that, without the readings themselves."""
        return written(quality.digested(self.readings, self.cfg), "digest")

    @cached_property
    def few(self) -> DataFrame:
        return written(quality.few(self.ordered), "few") if "ordered" in vars(self) else quality.few_of(self.digest, self.cfg)

    @cached_property
    def events(self) -> DataFrame:
        return written(steps.detect(self.few, self.cfg), "events")

    @cached_property
    def judged(self) -> DataFrame:
        return quality.undoubted(self.ordered).unionByName(self.decided)

    @cached_property
    def decided(self) -> DataFrame:
        return quality.decided(self.few, self.events, self.cfg)

    @cached_property
    def flags(self) -> DataFrame:
        some = quality.few_of(self.digest, self.cfg)  # flags are raised by these only
        return quality.quality_flags(quality.undoubted(some).unionByName(self.decided), self.cfg)

    @cached_property
    def days(self) -> DataFrame:
        late = steps.step_sums(self.decided.where("kept"))
        return steps.days_of_sums(quality.sums_of(self.digest).unionByName(late), self.events, lambda: self.judged.where("kept"))

    @cached_property
    def regions(self) -> DataFrame:
        """hive_id and region_id of each site with a position: the components within the radius, named by their smallest site. Sites of a cell within the radius are one node."""
        members, links = near_classes(self.sites, "hive_id", "latitude", "longitude", float(self.cfg["regions.region_radius_miles"]), self.cfg["regions.earth_radius_miles"], cells=True)
        found = regions.components(members.select("rep"), links.withColumnsRenamed({"rep_a": "id_a", "rep_b": "id_b"}), "rep")
        placed = written(members.join(found, "rep").select("_site", "component"), "placed")
        named = placed.groupBy("component").agg(F.min("_site").alias("name"))
        return written(placed.join(named, "component").groupBy(F.col("_site").alias("hive_id")).agg(F.min("name").alias("region_id")), "regions")

    @cached_property
    def day_types(self) -> DataFrame:
        return written(features.day_types(self.weather, self.cfg), "types")

    @cached_property
    def _beside(self) -> Future:
        """Regions and day types need no readings: their many small jobs run beside the pass over the readings."""
        pool = ThreadPoolExecutor(1, "combline")
        begun = pool.submit(inheritable_thread_target(lambda: (self.regions, self.day_types)))
        pool.shutdown(wait=False)
        return begun

    @cached_property
    def movements(self) -> DataFrame:
        """Rows per colony with what is compared. A colony of a site without a region is in one of its own."""
        beside, days = self._beside, self.days
        regions, types = beside.result()
        moved = features.movements(days, self.events, types, self.cfg)
        return written(moved.join(regions, "hive_id", "left").withColumn("region_id", F.coalesce("region_id", "hive_id")), "movements")

    @cached_property
    def features(self) -> DataFrame:
        """The same with the numbers of events and flags."""
        return written(features.with_counts(self.movements, self.events, quality.quality_counts(self.flags)), "features")

    @cached_property
    def described(self) -> DataFrame:
        """features with averages, shares and the most frequent text of the weather."""
        return features.with_weather(self.features, self.days, self.weather, self.cfg)

    @cached_property
    def comparisons(self) -> DataFrame:
        return written(scoring.comparisons(self.movements, self.cfg.metrics(), self.cfg), "comparisons")

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.scores(self.features, self.comparisons, self.cfg)

    @cached_property
    def gaps(self) -> DataFrame:
        """Silent colonies of all sites, both sides."""
        return self._silent(self.readings if self.history is None else self.history)

    def _silent(self, readings: DataFrame) -> DataFrame:
        sides = self.sites.where(F.col("hive_id").isNotNull()).select("hive_id").distinct().join(self.regions, "hive_id", "left")
        colonies = sides.withColumn("region_id", F.coalesce("region_id", "hive_id")).withColumn("colony_side", F.explode(F.array(F.lit("L"), F.lit("R"))))
        return scoring.reporting_gaps(readings, colonies, self.cfg)

    @cached_property
    def standing(self) -> DataFrame:
        """Scores with silent colonies marked and added."""
        return scoring.with_gaps(self.scores, self._silent(quality.last_seen(self.digest)) if self.history is None else self.gaps)

    @cached_property
    def sisters(self) -> DataFrame:
        return scoring.sister_metrics(self.movements, self.comparisons, self.cfg.metrics(), self.cfg)

    @cached_property
    def sister_sites(self) -> DataFrame:
        return scoring.sister_sites(self.movements, self.sisters, self.cfg)

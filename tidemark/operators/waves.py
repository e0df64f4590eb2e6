"""Reading events' sources live, asking the next one only where those before gave nothing.

A wave reads one position of the unfinished events: the offer interface, then what gave
nothing there as a page or notice, then the notices beside the pages.  What answers is
written under ``state`` before it is used, whole tables at a time, so a run that is
repeated after a crash goes on with the first table that is not there; all else follows
from these tables.  An address that an earlier wave has read is not asked again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import lots
from tidemark.schema import EVENT_FIELDS
from tidemark.sources import fetching, scratch, web
from tidemark.sources.scratch import written

#: Sources of an event that are read at most.
MOST = 4


def _unread(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses that nothing before has read."""
    return wanted.select("url").join(known.select("url").distinct(), "url", "left_anti")


def read_live(events: DataFrame, captured: str, state: str, source: fetching.Live | fetching.Stored, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lots and logs of events, as :func:`lots.read_events` gives them, from sources that
    are asked wave by wave, and what was asked (wave, url).  ``state`` is the run's own
    folder."""
    kept: list[DataFrame] = []
    with scratch.scope(kept):
        kept += _read(events, captured, state, source, most)
    return kept[0], kept[1], kept[2]


def _read(events: DataFrame, captured: str, state: str, source: fetching.Live | fetching.Stored, most: int) -> list[DataFrame]:
    spark = events.sparkSession
    events = events.select("n", *EVENT_FIELDS)
    wanted = written(lots.sources_of(events, most), "wanted")
    known, paged = spark.createDataFrame([], web.SCHEMA), spark.createDataFrame([], web.OFFERS)
    requests = spark.createDataFrame([], "wave int, url string")
    read: list[dict[str, DataFrame]] = []
    ended: DataFrame | None = None
    for k in range(most):
        here = wanted.filter(F.col("pos") == k)
        here = written(here if ended is None else here.join(ended, "n", "left_anti"), "wave")
        if read and here.isEmpty():
            break

        def ask(wanted: DataFrame, name: str, get=source.answers, wave: int = k) -> DataFrame:
            return fetching.once(get(_unread(wanted, known)), f"{state}/wave-{wave}/{name}")

        served = here.filter(U.served_by_api("url"))
        offered = fetching.once(source.offers(_unread(served.filter(U.event_id("url") != ""), paged)), f"{state}/wave-{k}/offers")
        paged = paged.unionByName(offered)
        _, attempts = lots.offer_lots(served.join(events, "n"), paged, captured)
        rest = here.join(attempts.filter("lots > 0").select(*lots.KEYS), list(lots.KEYS), "left_anti")
        answers = ask(rest, "answers")
        known = known.unionByName(answers)
        beside = lots.with_notices(lots.pages_of(lots.answers_of(rest, known)), events).select(F.explode("notices").alias("url"))
        notices = ask(beside, "notices")
        known = known.unionByName(notices)
        read.append(lots.read_sources(events, here, known, captured, paged))
        done = read[-1]["sources"].filter("ends = 1").select("n")
        ended = done if ended is None else ended.unionByName(done)
        asked = offered.select("url").distinct().unionByName(answers.select("url")).unionByName(notices.select("url"))
        requests = requests.unionByName(asked.select(F.lit(k).alias("wave"), "url"))
    whole = {name: reduce(DataFrame.unionByName, [r[name] for r in read]) for name in read[0]}
    return [*lots.concluded(events, whole, captured), written(requests, "requests")]

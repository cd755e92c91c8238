"""Participation analysis of one survey table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation

from rollcall.columns import DEFAULT_COLUMNS, ORD, SurveyColumns
from rollcall.operators import participation as p
from rollcall.operators import ranges, stats
from rollcall.operators.joins import join_small
from rollcall.operators.rows import end_time_rows
from rollcall.session import once


@dataclass(frozen=True)
class Participation:
    """Every result of the analysis.

    The counts per participant and day are made by one pass over the survey, when
    the first result is asked for, and kept: all other results are small work on
    them. The latest incentives are the one other pass. Leave the audio counts out
    of the first pass with ``with_audio=False`` if no audio result is wanted.
    """

    survey: DataFrame
    order_by: Sequence[str] = ORD
    cols: SurveyColumns = DEFAULT_COLUMNS
    policy: str = "text"
    with_audio: bool = True

    @cached_property
    def _rejects(self) -> Observation:
        return Observation()

    @cached_property
    def _series(self) -> DataFrame:
        return once(p.daily_series(self.survey, self.cols, self.policy, self.order_by, self._rejects))

    @cached_property
    def daily(self) -> DataFrame:
        if self.with_audio:
            return self._series.filter("not audio").drop("audio")
        return once(p.daily_entries(self.survey, self.cols, self.policy, self.order_by, self._rejects))

    def rejects(self) -> DataFrame:
        """Rows read, without a day, and with a malformed day, per kind; counted by the pass that counts entries."""
        self.daily  # noqa: B018 - the pass
        return p.reject_table(self.survey.sparkSession, self._rejects)

    @cached_property
    def totals(self) -> DataFrame:
        return p.total_entries(self.daily)

    @cached_property
    def incentive(self) -> DataFrame:
        return p.latest_incentive(self.survey, self.order_by, self.cols)

    @cached_property
    def audio_daily(self) -> DataFrame:
        """Audio counts; none at all when the survey has no ``end_time`` row."""
        audio = self._series.filter("audio").drop("audio")
        if not p.days(self.daily).isEmpty():
            return audio
        return audio.filter(end_time_rows(self.survey, self.cols).exists())

    @cached_property
    def audio_totals(self) -> DataFrame:
        return p.total_audio(self.audio_daily)

    @cached_property
    def day_names(self) -> list[str]:
        return p.day_list(self.daily)

    def summary(self) -> DataFrame:
        return p.summary_wide(self.daily, None, self.incentive, self.day_names, sort=True)

    def summary_pages(self, size: int = p.MAX_DAY_COLUMNS) -> list[DataFrame]:
        """The summary in pages of day columns, where one table would be too wide."""
        return p.summary_pages(self.daily, self.incentive, size, sort=True)

    def zero_filled(self) -> DataFrame:
        """Every participant with every day, however many days there are."""
        return p.zero_fill(None, self.daily, p.days(self.daily))

    def audio(self) -> DataFrame:
        return p.audio_wide(self.audio_daily, None, self.day_names, sort=True)

    def stats(self) -> DataFrame:
        return stats.participation_stats(self.daily, self.totals)

    def chart(self, pid: str | None = None, n: str | int | None = "all") -> DataFrame:
        """Series of all participants, or of one, over the last ``n`` days."""
        shown = ranges.last_days(self.daily, n)
        return stats.chart_daily(shown) if pid is None else stats.chart_participant(shown, pid)

    def view(self, n: str | int | None = "all", pid: str | None = None) -> DataFrame:
        totals = p.with_incentive(self.totals, self.incentive)
        return ranges.filtered_view(self.daily, totals, n, pid)

    def audio_view(self, n: str | int | None = "all", pid: str | None = None) -> DataFrame:
        """Audio counts of the days shown: days with entries, anchored on the newest of them."""
        shown = join_small(self.audio_daily, p.days(self.daily), ["day"], "left_semi")
        return ranges.filtered_view(shown, self.audio_totals, n, pid, anchor=self.daily)

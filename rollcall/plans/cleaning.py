"""Cleaning of upload repeats in one survey table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from rollcall.columns import DEFAULT_COLUMNS, ORD
from rollcall.operators import cleaning as c


@dataclass(frozen=True)
class Cleaning:
    """Cleaned rows, removed rows, review and figures.

    The repeated keys are found when the first result is asked for, and shared by
    all of them; so are the marked rows of these keys.
    """

    survey: DataFrame
    order_by: Sequence[str] = ORD
    keys: Sequence[str] = c.KEYS
    date_col: str = DEFAULT_COLUMNS.date
    require_date: bool = False

    @cached_property
    def repeated(self) -> DataFrame:
        return c.repeated_keys(*self._how)

    @property
    def _how(self) -> tuple:
        return (self.survey, self.keys, self.date_col, self.order_by, self.require_date)

    def cleaned(self) -> DataFrame:
        return c.clean(*self._how, repeated=self.repeated)

    @cached_property
    def _marked(self) -> DataFrame:
        survey, keys, date_col, order_by, require_date = self._how
        return c.members(survey, self.repeated, keys, date_col, order_by, require_date)

    def removed(self) -> DataFrame:
        return c.clean_removed(*self._how, marked=self._marked)

    def review(self, groups: int | None = None) -> DataFrame:
        if groups is not None:
            return c.clean_review(*self._how, groups=groups, repeated=self.repeated)
        return c.clean_review(*self._how, marked=self._marked)

    def groups(self, limit: int | None = None) -> DataFrame:
        return c.duplicate_groups(*self._how, limit=limit, repeated=self.repeated)

    def stats(self) -> DataFrame:
        return c.cleaning_stats(*self._how, repeated=self.repeated)

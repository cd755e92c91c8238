"""Collation, cleaning and participation analysis of survey exports on Spark."""

from rollcall.columns import ORD, SurveyColumns
from rollcall.plans.cleaning import Cleaning
from rollcall.plans.collate import collate, collate_tables
from rollcall.plans.participation import Participation
from rollcall.session import session

__all__ = ["ORD", "Cleaning", "Participation", "SurveyColumns", "collate", "collate_tables", "session"]

"""Discrete-choice analytics on Spark."""

from choicelake.operators.reshape import convert_long_to_wide, convert_wide_to_long
from choicelake.plans.bootstrap import Boot
from choicelake.plans.models import create_choice_model, load_model

__version__ = "0.1.0"
__all__ = ["Boot", "convert_long_to_wide", "convert_wide_to_long", "create_choice_model", "load_model"]

"""Registered queries and the canonical inputs they run on."""

from tillsight.plans import experimentation, modelling, retail, value, voice  # noqa: F401
from tillsight.plans.registry import CHECKS, QUERIES  # noqa: F401

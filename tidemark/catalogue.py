"""Importing this module registers every operator."""

from tidemark.functions import scalars  # noqa: F401
from tidemark.operators import fairness, history, joins, scans, windows  # noqa: F401  # isort: skip
from tidemark.plans import scheduling  # noqa: F401  # isort: skip
from tidemark.operators import commands  # noqa: F401  # isort: skip
from tidemark.streaming import live  # noqa: F401  # isort: skip
from tidemark import api  # noqa: F401  # isort: skip

"""Named queries over the derived catalogues, each with SQL that says the same where SQL can."""

from tremorlake.plans import catalogue, ingest, matched, matrices, modelling, programs, tidal, twins  # noqa: F401
from tremorlake.plans.registry import QUERIES, SQL  # noqa: F401

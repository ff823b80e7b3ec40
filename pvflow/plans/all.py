"""Imports every plan module so that the catalogue is complete."""

from pvflow.plans import archive, commands, handlers, latest, metrics, nested, pipelines, registry, snapshots, streams  # noqa: F401
from pvflow.plans.catalogue import ORACLE, QUERIES  # noqa: F401

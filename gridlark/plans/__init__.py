"""Registered queries; importing the package registers all of them."""

from gridlark.plans import alignments, catalogue, experiments, modelling  # noqa: F401

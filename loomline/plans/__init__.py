"""Queries; importing the modules registers them."""

from loomline.plans import contexts, control_plane, graphs, observation, policies, retrieval, streams  # noqa: F401

"""The providers that come with the library."""

from .base import Provider
from .derived import Derived
from .film import Film
from .history import History
from .identity import Identity
from .movie_mgmt import MovieMgmt
from .probe import Probe
from .rollup import Rollup
from .series_mgmt import SeriesMgmt

ALL = (Identity, Probe, Film, History, MovieMgmt, SeriesMgmt, Derived, Rollup)


def default_providers() -> list[Provider]:
    return [kind() for kind in ALL]


__all__ = ["Provider", "ALL", "default_providers", *[kind.__name__ for kind in ALL]]

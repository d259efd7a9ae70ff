"""Version banner."""

from __future__ import annotations

from . import __version__
from .contracts import default_of


def main() -> None:
    print(f"matchweft {__version__}")
    print("Domain contracts loaded.")
    print(f"GameState schema version: {default_of('GameState', 'schema_version')}")
    print(f"MatchManifest schema version: {default_of('MatchManifest', 'schema_version')}")

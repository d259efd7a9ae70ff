"""The record contracts, declared once; schemas, validation and documentation derive from here.

A line of a contract is ``field type[?] [>=n | a..b] [= default]``. ``?`` allows null. Without a
default the field must be present. Types: str, int, float, bool, datetime, json (an object of
any content), a domain, a contract, list<..>, pair (two whole numbers).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import types as T

# The domains of the contracts.
DOMAINS: dict[str, tuple[str, ...]] = {
    "GamePhase": ("unknown", "planning", "combat", "carousel", "augment", "pve", "post_game"),
    "EvidenceKind": ("frame", "roi", "video_segment", "external_api"),
    "ObservationKind": ("scene", "stage", "round", "gold", "hp", "level", "xp", "shop", "board", "bench", "inventory", "augments", "traits", "opponent"),
    "EventType": (
        "match_start", "match_end", "round_start", "round_end", "gold_changed", "hp_changed", "level_changed", "xp_changed", "shop_changed",
        "buy_unit", "sell_unit", "refresh_shop", "purchase_xp", "equip_item", "move_unit", "choose_augment", "unit_upgraded", "unknown",
    ),
    "ActionType": (
        "buy_unit", "sell_unit", "refresh_shop", "purchase_xp", "equip_item", "move_unit", "choose_augment",
        "hold_economy", "level_to", "roll_to_gold", "roll_until_upgrade", "transition_to", "stabilize",
    ),
    "DecisionType": ("level_up", "rolldown", "slow_roll", "economy_hold", "item_slam", "augment_choice", "composition_transition", "unit_upgrade", "positioning_change", "other"),
    "Severity": ("info", "minor", "major", "critical"),
    "EvidenceType": ("rule", "descriptive_statistics", "value_model", "counterfactual_model", "offline_rl"),
}
ATOMIC_ACTIONS = DOMAINS["ActionType"][:7]

# The fields of the contracts. Every contract has schema_version besides.
FIELDS = """
EvidenceRef
  evidence_id str
  match_id str
  timestamp_s float >=0
  kind EvidenceKind
  uri str
  sha256 str? = null
  source str = "screen"
Observation
  observation_id str
  match_id str
  timestamp_s float >=0
  kind ObservationKind
  value json
  confidence float 0..1
  evidence_ids list<str> = []
  producer_version str
GameEvent
  event_id str
  match_id str
  timestamp_s float >=0
  event_type EventType
  payload json = {}
  confidence float 0..1
  evidence_ids list<str> = []
  observation_ids list<str> = []
  producer_version str
BoardPosition
  row int >=0
  col int >=0
UnitInstance
  instance_id str
  champion_id str? = null
  stars int? 1..4 = null
  position BoardPosition? = null
  items list<str> = []
  confidence float 0..1 = 1.0
PlayerState
  hp int? >=0 = null
  gold int? >=0 = null
  level int? >=1 = null
  xp int? >=0 = null
ShopState
  slots list<str?> = []
  locked bool? = null
OpponentSnapshot
  player_id str
  hp int? >=0 = null
  level int? >=1 = null
  board list<UnitInstance> = []
  confidence float 0..1 = 1.0
GameState
  state_id str
  match_id str
  timestamp_s float >=0
  patch str? = null
  set_id str? = null
  stage int? >=1 = null
  round int? >=1 = null
  phase GamePhase = "unknown"
  player PlayerState = {}
  shop ShopState = {}
  board list<UnitInstance> = []
  bench list<UnitInstance> = []
  inventory list<str> = []
  augments list<str> = []
  active_traits list<str> = []
  observed_opponents list<OpponentSnapshot> = []
  source_event_ids list<str> = []
  confidence float 0..1 = 1.0
  reducer_version str
SemanticAction
  action_id str
  action_type ActionType
  params json = {}
  legal bool? = null
DecisionEpisode
  decision_id str
  match_id str
  decision_type DecisionType
  start_timestamp_s float >=0
  end_timestamp_s float >=0
  state_before_id str
  state_after_id str? = null
  event_ids list<str> = []
  action_ids list<str> = []
  summary json = {}
  confidence float 0..1 = 1.0
  extractor_version str
Finding
  finding_id str
  match_id str
  decision_id str? = null
  category str
  title str
  score float? = null
  severity Severity = "info"
  confidence float 0..1 = 1.0
  evidence_type EvidenceType = "rule"
  metrics json = {}
  explanation str? = null
  evidence_ids list<str> = []
TransitionSample
  match_id str
  state_id str
  action SemanticAction
  next_state_id str?
  timestamp_s float >=0
  done bool = false
  final_placement int? 1..8 = null
  action_mask list<str> = []
  behavior_rank str? = null
  state_confidence float 0..1 = 1.0
  action_confidence float 0..1 = 1.0
PipelineVersions
  capture str = "0.1.0"
  perception str = "0.1.0"
  tracking str = "0.1.0"
  reducer str = "0.1.0"
  decision_extractor str = "0.1.0"
  analyzer str = "0.1.0"
  game_data str = "unknown"
MatchManifest
  match_id str
  started_at datetime
  ended_at datetime? = null
  patch str? = null
  set_id str? = null
  client_resolution pair? = null
  versions PipelineVersions = {}
  final_placement int? = null
  notes str? = null
"""
SCHEMA_VERSION = "schema_version int >=1 = 1"


@dataclass(frozen=True)
class Field:
    """One field of a contract. ``low`` and ``high`` are inclusive bounds; ``default`` is JSON text, None if the field must be present."""

    name: str
    type: str
    nullable: bool
    low: float | None
    high: float | None
    default: str | None

    @property
    def element(self) -> tuple[str, bool] | None:
        """Type and nullability of a list's elements."""
        inner = re.fullmatch(r"list<(\w+)(\??)>", self.type)
        return (inner[1], bool(inner[2])) if inner else None


_LINE = re.compile(r"(\w+) ([\w<>?]+?)(\?)?(?: >=(\d+)| (\d+)\.\.(\d+))?(?: = (.+))?")


def _field(line: str) -> Field:
    name, kind, null, least, low, high, default = _LINE.fullmatch(line.strip()).groups()
    number = lambda x: None if x is None else float(x)
    return Field(name, kind, bool(null), number(least or low), number(high), default)


@cache
def contracts() -> dict[str, tuple[Field, ...]]:
    """All contracts by name, each with schema_version last."""
    out: dict[str, list[Field]] = {}
    for line in FIELDS.strip().splitlines():
        if line.startswith(" "):
            out[name].append(_field(line))
        else:
            name = line
            out[name] = []
    return {k: (*v, _field(SCHEMA_VERSION)) for k, v in out.items()}


_SCALARS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType(), "json": T.StringType()}


def spark_type(kind: str) -> T.DataType:
    """Spark's type for a contract type; json is canonical JSON text, so that rows stay comparable."""
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind in DOMAINS:
        return T.StringType()
    if kind == "pair":
        return T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])
    if inner := re.fullmatch(r"list<(\w+)(\??)>", kind):
        return T.ArrayType(spark_type(inner[1]), bool(inner[2]))
    return schema(kind)


@cache
def schema(contract: str) -> T.StructType:
    """The contract as StructType; defaults are in the fields' metadata."""
    fields = contracts()[contract]
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable, {} if f.default is None else {"default": f.default}) for f in fields])


def default_of(contract: str, name: str) -> object:
    """Default value of a field, as the model would fill it; KeyError where it must be given."""
    text = schema(contract)[name].metadata["default"]
    return json.loads(text)

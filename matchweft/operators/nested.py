"""Nested records as flat tables, by Merkle identities of their subtrees.

Every unit is written in one canonical form and hashed; a board's hash covers the hashes of
its units, in order, and an opponent's its own fields and its board's hash, so equal subtrees
have equal hashes wherever they occur. A subtree is stored once, in a node table; where it
occurs is kept in bridge tables of parent, place and child.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

OWN_BOARD = -1


@dataclass(frozen=True)
class NestedTables:
    """Bridge tables (state_boards, state_opponents, board_units, board_items, unit_items) and node tables (opponents, units)."""

    state_boards: DataFrame
    state_opponents: DataFrame
    board_units: DataFrame
    board_items: DataFrame
    unit_items: DataFrame
    opponents: DataFrame
    units: DataFrame

    @property
    def state_units(self) -> DataFrame:
        """Units of the states' own boards: state_id, unit_pos, unit_key."""
        own = self.state_boards.where(F.col("opponent_pos") == OWN_BOARD)
        return own.join(self.board_units, "board_key").select("state_id", "unit_pos", "unit_key")

    @property
    def opponent_units(self) -> DataFrame:
        """Units of each distinct opponent: opponent_key, unit_pos, unit_key."""
        return self.opponents.join(self.board_units, "board_key").select("opponent_key", "unit_pos", "unit_key")


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256 over the canonical JSON of the parts, as hex; null fields are written out."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256), 1, 32)


def _key(*parts: Column) -> Column:
    """The digest as a key that is never null, so that joins on it need not look at it first."""
    return F.coalesce(F.unhex(_digest(*parts)), F.lit(b""))


def _board_key(board: Column) -> Column:
    units = F.transform(board, lambda u: F.when(u.isNotNull(), _digest(u.alias("unit"))))
    return _key(units.alias("board"))


def _other_fields(kind: T.StructType, without: set[str]) -> list[str]:
    return [f.name for f in kind.fields if f.name not in without]


def _placed(df: DataFrame, keys: list[str], array: str, place: str, name: str) -> DataFrame:
    """A row for each element that is not null, with its place."""
    rows = df.select(*keys, F.posexplode(array).alias(place, name))
    return rows.where(F.col(name).isNotNull()).withColumn(place, F.col(place).cast("bigint"))


def flatten_boards(states: DataFrame) -> NestedTables:
    """The boards of states and of their observed opponents as flat tables.

    Input: ``state_id``, ``board`` and ``observed_opponents``; further columns are ignored.
    Places count from 0 with null elements included; opponent_pos is -1 for a state's own board.
    A null array or element has no rows of its own; its place stays unused. Re-sent states give
    no second row. Empty tables give empty tables.

    Each table is a plan of its own over one scan of the input, pruned to what it needs; what occurs
    is joined with what is stored by the board's key, so occurrences are shuffled as ids and
    places, and contents once for each distinct board.
    """
    opponent_type = states.schema["observed_opponents"].dataType.elementType
    own = _other_fields(opponent_type, {"board"})
    # A key stands for its contents, so nodes are made single by plain distinct rows, which hash without sorting and combine before the shuffle.
    mine = F.array(F.struct(F.lit(OWN_BOARD).cast("bigint").alias("opponent_pos"), F.col("board").alias("board")))
    others = F.transform("observed_opponents", lambda o, i: F.struct(i.cast("bigint").alias("opponent_pos"), o["board"].alias("board")))
    seen = states.select("state_id", F.explode(F.concat(mine, F.coalesce(others, F.slice(mine, 1, 0)))).alias("b")).where("size(b.board) > 0")
    boards = seen.select("state_id", "b.opponent_pos", _board_key(F.col("b.board")).alias("board_key"), F.col("b.board").alias("board"))
    nodes = boards.select("board_key", "board").distinct()
    placed = _placed(nodes, ["board_key"], "board", "unit_pos", "unit").withColumn("unit_key", _key(F.col("unit").alias("unit")))
    # Lists are kept by one aggregate on the key, whose exchange and order the join by key then shares.
    item_lists = boards.select("board_key", F.transform("board", lambda u: u["items"]).alias("items")).groupBy("board_key").agg(F.first("items").alias("items"))
    of_board = _placed(_placed(item_lists, ["board_key"], "items", "unit_pos", "list"), ["board_key", "unit_pos"], "list", "item_pos", "item_id")
    opponents = _placed(states, ["state_id"], "observed_opponents", "opponent_pos", "o").withColumn("board_key", F.when(F.size("o.board") > 0, _board_key(F.col("o.board"))))
    opponent_key = _key(*[F.col(f"o.{c}").alias(c) for c in own], F.hex("board_key").alias("board"))
    opponents = opponents.withColumn("opponent_key", opponent_key)
    return NestedTables(
        state_boards=boards.select("state_id", "opponent_pos", "board_key").distinct(),
        state_opponents=opponents.select("state_id", "opponent_pos", "opponent_key").distinct(),
        board_units=placed.select("board_key", "unit_pos", "unit_key"),
        board_items=of_board,
        unit_items=_placed(placed.select("unit_key", F.col("unit.items").alias("items")).distinct(), ["unit_key"], "items", "item_pos", "item_id"),
        opponents=opponents.select("opponent_key", *[F.col(f"o.{c}").alias(c) for c in own], "board_key").distinct(),
        units=placed.select("unit_key", *[F.col(f"unit.{c}").alias(c) for c in _unit_fields(states)]).distinct(),
    )


def _unit_fields(states: DataFrame) -> list[str]:
    return _other_fields(states.schema["board"].dataType.elementType, {"items"})


def unit_occurrences(tables: NestedTables) -> DataFrame:
    """Every occurrence of a unit: state_id, opponent_pos (-1: the state's own board), unit_pos, unit_key."""
    return tables.state_boards.join(tables.board_units, "board_key").select("state_id", "opponent_pos", "unit_pos", "unit_key")


def item_occurrences(tables: NestedTables) -> DataFrame:
    """Every non-null item with its state, opponent, unit and place."""
    return tables.state_boards.join(tables.board_items, "board_key").select("state_id", "opponent_pos", "unit_pos", "item_pos", "item_id")


def rebuild_boards(tables: NestedTables) -> DataFrame:
    """The way back: one row for each state and opponent_pos with the units of its board in order, each a struct of unit_pos and unit_key."""
    rows = unit_occurrences(tables)
    return rows.groupBy("state_id", "opponent_pos").agg(F.array_sort(F.collect_list(F.struct("unit_pos", "unit_key"))).alias("board"))


def nested_counts(tables: NestedTables) -> DataFrame:
    """Rows of each flat table, by name."""
    named = ["state_boards", "state_opponents", "board_units", "board_items", "unit_items", "opponents", "units"]
    return reduce(DataFrame.unionByName, [getattr(tables, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in named])

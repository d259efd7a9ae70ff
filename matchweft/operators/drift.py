"""Schemas that drift between the files of a stream.

Every file gets a schema fingerprint: its paths with their JSON types and a bounded profile
of the values. The fingerprints of a stream are walked in file order; what differs between
two is a change, and the changes are the migration steps. Chained from the first file on,
they say under which name each field of a file belongs in the one table of its record type.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..contracts import contracts

BUCKETS = 256
SAME_VALUES, SAME_NAME, LIKE_NAME = 0.5, 0.99, 0.5
FILES_AT_ONCE = 256
_PROFILE = "stream_id string, record_type string, file_no bigint, profile string"
_PRINT = "stream_id string, record_type string, file_no bigint, fingerprint string, fields string"
_DIGITS, _WORD = re.compile(r"\d+"), re.compile(r"[A-Z]?[a-z]+")
#: Fields of the record contracts; a chain that passes through one of these names ends there.
CONTRACT_FIELDS = {
    "observation": {"observation_id": "text", "match_id": "text", "timestamp_s": "number", "kind": "text", "value": "object", "confidence": "number", "evidence_ids": "array", "producer_version": "text", "schema_version": "number"},
    "game_state": {"state_id": "text", "match_id": "text", "timestamp_s": "number", "stage": "number", "round": "number", "phase": "text", "player": "object", "shop": "object", "board": "array", "confidence": "number", "reducer_version": "text", "schema_version": "number"},
}


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "text", list: "array", dict: "object"}[type(value)]


def _buckets(text: str) -> list[int]:
    """Buckets of a text's shapes: digits as one; then words as one too and each sign only where it first comes, where that leaves more than words."""
    fine = _DIGITS.sub("9", text)
    coarse = "".join(dict.fromkeys(_WORD.sub("w", fine)))
    out = [zlib.crc32(fine.encode()) % BUCKETS]
    return [*out, BUCKETS + zlib.crc32(coarse.encode()) % BUCKETS] if re.search(r"[A-Z9]", coarse) else out


def _json(text: str | None) -> object:
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def parse_object(payload: str | None) -> dict | None:
    """The JSON object of a line; None where the line is cut off or no object."""
    value = _json(payload)
    return value if isinstance(value, dict) else None


def _observe(value: object, path: str, seen: dict) -> None:
    """Add one filled value to the profile of its path; ``p[]`` is the path of an array's elements."""
    kind = _kind(value)
    entry = seen[path, kind]
    entry["n"] += 1
    if kind == "number":
        number = float(value)
        entry["n_frac"] += number != int(number) if np.isfinite(number) else 1
        entry["low"], entry["high"], entry["total"] = min(entry["low"], number), max(entry["high"], number), entry["total"] + number
    elif kind == "text":
        for b in _buckets(value):
            entry["hist"][b] += 1
    elif kind == "array":
        for x in value:
            if x is not None:
                _observe(x, path + "[]", seen)
    elif kind == "object":
        for name, x in value.items():
            if x is not None:
                _observe(x, f"{path}.{name}" if path else name, seen)


def _entry() -> dict:
    return {"n": 0, "n_frac": 0, "low": np.inf, "high": -np.inf, "total": 0.0, "hist": defaultdict(int)}


def _profile_rows(files: dict) -> pd.DataFrame:
    rows = [(*file, json.dumps([[path, kind, e["n"], e["n_frac"], e["low"], e["high"], e["total"], e["hist"]] for (path, kind), e in seen.items()])) for file, seen in files.items() if seen]
    return pd.DataFrame(rows, columns=["stream_id", "record_type", "file_no", "profile"]).astype({"file_no": "Int64"})


def _profile_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each file that has lines in the partition; where lines lie in the order of their files, each file is held only while it lasts."""
    files: dict = {}
    for df in batches:
        for (stream, record_type, file_no), group in df.groupby(["stream_id", "record_type", "file_no"], dropna=False, sort=False):
            file = (stream, None if pd.isna(record_type) else record_type, file_no)
            if file not in files:
                if len(files) >= FILES_AT_ONCE:
                    yield _profile_rows(files)
                    files = {}
                files[file] = defaultdict(_entry)
            for payload in group["payload"]:
                record = parse_object(payload)
                if record is not None:
                    _observe(record, "", files[file])
    yield _profile_rows(files)


def _merge_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up the profiles of each file; rows come in the order of their files."""
    now, total = None, {}

    def done() -> tuple:
        fields = [{"path": p, "kind": k, "n": e["n"], "n_frac": e["n_frac"], "low": e["low"], "high": e["high"], "total": e["total"], "shapes": e["hist"]} for (p, k), e in sorted(total.items())]
        text = json.dumps(sorted(total))
        return (*now, hashlib.sha256(text.encode()).hexdigest(), json.dumps(fields))

    for df in batches:
        rows = []
        for stream, record_type, file_no, profile in df.itertuples(index=False):
            file = (stream, record_type, file_no)
            if file != now:
                if now is not None:
                    rows.append(done())
                now, total = file, {}
            for path, kind, n, n_frac, low, high, amount, hist in json.loads(profile):
                e = total.setdefault((path, kind), _entry())
                e["n"], e["n_frac"], e["total"] = e["n"] + n, e["n_frac"] + n_frac, e["total"] + amount
                e["low"], e["high"] = min(e["low"], low), max(e["high"], high)
                for bucket, c in hist.items():
                    e["hist"][int(bucket)] += c
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PRINT.split(", ")]).astype({"file_no": "Int64"})
    if now is not None:
        yield pd.DataFrame([done()], columns=[x.split()[0] for x in _PRINT.split(", ")]).astype({"file_no": "Int64"})


def schema_fingerprints(raw: DataFrame) -> DataFrame:
    """One row for each file: stream_id, record_type, file_no, fingerprint, fields.

    ``fields`` has, for each path and JSON type, the number of filled values, the number of
    fractions, range and sum of numbers, and a histogram of value shapes in 2 x 256
    buckets (digits count as one, in the second half words too), so its size depends on the schema and not on the rows. Lines that
    are no JSON object are passed over; a file of such lines only has no row. Each partition
    sends one row for each of its files, so a file of any length is a few rows when it is shuffled.
    """
    rows = raw.select("stream_id", "record_type", F.col("file_no").cast("bigint").alias("file_no"), "payload").where("stream_id is not null and file_no is not null")
    file = ["stream_id", "record_type", "file_no"]
    return rows.mapInPandas(_profile_partition, _PROFILE).repartition(*file).sortWithinPartitions(*file).mapInPandas(_merge_partition, _PRINT)


class _Node:
    """A field: its JSON type, value profile, and the fields below it (of an object or of the objects in an array)."""

    __slots__ = ("children", "elements", "kind", "n", "profile")

    def __init__(self) -> None:
        self.kind, self.n, self.profile, self.children, self.elements = "", 0, {}, {}, {}


def _tree(fields: str) -> dict[str, _Node]:
    root = _Node()
    for f in json.loads(fields):
        if not f["path"]:
            continue
        f["shapes"] = {int(k): v for k, v in f["shapes"].items()}
        node = root
        for step in re.split(r"\.", f["path"]):
            name = step.replace("[]", "")
            node = node.children.setdefault(name, _Node())
        if f["path"].endswith("[]"):
            node.elements[f["kind"]] = f
        elif f["n"] > node.n:
            node.kind, node.n, node.profile = f["kind"], f["n"], f
    return root.children


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _name_likeness(a: str, b: str) -> float:
    """1 for the same name in another style; less for shared words or a shared beginning."""
    x, y = _plain(a), _plain(b)
    if x == y:
        return 1.0
    words = lambda s: set(re.findall(r"[a-z0-9]+", re.sub(r"([A-Z])", r"_\1", s).lower()))
    u, w = words(a), words(b)
    shared = len(u & w) / len(u | w) if u | w else 0.0
    return max(shared, 0.6 if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)) else 0.0)


def _text_likeness(a: dict, b: dict) -> float:
    """Likeness of two text fields' shapes; shared coarse shapes count a little less."""
    part = lambda d, low: {k: v for k, v in (d.get("shapes") or {}).items() if low <= k < low + BUCKETS}
    return max(_cosine(part(a, 0), part(b, 0)), 0.8 * _cosine(part(a, BUCKETS), part(b, BUCKETS)))


def _cosine(a: dict, b: dict) -> float:
    top = sum(v * b[k] for k, v in a.items() if k in b)
    return top / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 if top else 0.0


def _number_likeness(a: dict, b: dict) -> float:
    """How far two number fields could hold the same quantity: like shares of fractions, like size, overlapping ranges."""
    if abs(a["n_frac"] / a["n"] - b["n_frac"] / b["n"]) > 0.5:
        return 0.0
    x, y = abs(a["total"] / a["n"]), abs(b["total"] / b["n"])
    if max(x, y) > 4 * max(min(x, y), 1e-9):
        return 0.0
    shared = min(a["high"], b["high"]) - max(a["low"], b["low"])
    if min(a["n_frac"] / a["n"], b["n_frac"] / b["n"]) >= 0.5:
        return 0.6 if shared >= 0 else 0.5
    if shared < 0:
        return 0.0
    narrow = min(a["high"] - a["low"], b["high"] - b["low"])
    return min(1.0, shared / narrow) if narrow > 0 else 0.4  # one value alone tells little


def _value_likeness(a: _Node, b: _Node) -> float:
    if a.kind == "text":
        return _text_likeness(a.profile, b.profile)
    if a.kind == "number":
        return _number_likeness(a.profile, b.profile)
    if a.children or b.children:
        return len(a.children.keys() & b.children.keys()) / len(a.children.keys() | b.children.keys())
    if a.kind == "array":
        scores = [_text_likeness(a.elements[k], b.elements[k]) if k == "text" else _number_likeness(a.elements[k], b.elements[k]) if k == "number" else 0.3 for k in a.elements.keys() & b.elements.keys()]
        return max(scores, default=0.0)
    return 0.3


def _renames(gone: dict[str, _Node], new: dict[str, _Node]) -> dict[str, str]:
    """Pairs of a removed and an added field of one parent whose values go on, best first."""
    scored = []
    for a, x in gone.items():
        for b, y in new.items():
            if x.kind == y.kind:
                name, values = _name_likeness(a, b), _value_likeness(x, y)
                if name >= SAME_NAME or values >= SAME_VALUES or (name >= LIKE_NAME and (values >= 0.25 or x.kind == "text")):
                    scored.append((-(name + values), a, b))
    found: dict[str, str] = {}
    for _, a, b in sorted(scored):
        if a not in found and b not in found.values():
            found[a] = b
    return found


def compare(old: dict[str, _Node], new: dict[str, _Node], at_old: str = "", at_new: str = "") -> list[tuple[str, str, str]]:
    """Changes from one schema to the next: (change, old path, new path). A whole object or array of objects counts once."""
    gone = {k: v for k, v in old.items() if k not in new}
    come = {k: v for k, v in new.items() if k not in old}
    pairs = _renames(gone, come)
    out = [("renamed", at_old + a, at_new + b) for a, b in pairs.items()]
    out += [("removed", at_old + a, "") for a in gone if a not in pairs]
    out += [("added", "", at_new + b) for b in come if b not in pairs.values()]
    for a, b in [*((k, k) for k in old if k in new), *pairs.items()]:
        x, y = old[a], new[b]
        if x.kind != y.kind:
            out.append(("retyped", at_old + a, at_new + b))
        elif x.children and y.children:
            step = "[]." if x.kind == "array" else "."
            out += compare(x.children, y.children, at_old + a + step, at_new + b + step)
    return out


def _follow(now: dict[str, _Node], changes: list[tuple[str, str, str]], before: dict[str, str], kinds: dict[str, str], contract: dict[str, str]) -> dict[str, str]:
    """The path in the one table of every path of this file, from those of the file before.

    A renamed field keeps the place it had; so does what lies below it. A new field is placed
    under its parent. Names of the contract stand for themselves. ``kinds`` gets the JSON
    type that each place had first.
    """
    came_from = {new: old for change, old, new in changes if change == "renamed"}
    out: dict[str, str] = {}

    def walk(children: dict[str, _Node], at: str, was_at: str, place: str) -> None:
        for name, node in children.items():
            old = came_from.get(at + name, was_at + name)
            out[at + name] = before.get(old, place + name) if at or name not in contract else name
            kinds.setdefault(out[at + name], contract.get(name, node.kind) if not at else node.kind)
            step = "[]." if node.kind == "array" else "."
            walk(node.children, at + name + step, old + step, out[at + name] + step)

    walk(now, "", "", "")
    return out


_STEPS = "stream_id string, record_type string, file_no bigint, fingerprint string, rules string, changes array<struct<change:string,old_path:string,new_path:string>>"


def _migrate_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stream, before, names, kinds = None, None, {}, {}
    for df in batches:
        rows = []
        for s, record_type, file_no, fingerprint, fields in df[["stream_id", "record_type", "file_no", "fingerprint", "fields"]].itertuples(index=False):
            if s != stream:
                stream, before, names, kinds = s, None, {}, {}
            now = _tree(fields)
            changes = [] if before is None else compare(before, now)
            names = _follow(now, changes, names, kinds, CONTRACT_FIELDS.get(record_type, {}))
            rules = json.dumps({path: [place, kinds[place]] for path, place in names.items()})
            rows.append((s, record_type, file_no, fingerprint, rules, [dict(zip(("change", "old_path", "new_path"), c)) for c in changes]))
            before = now
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STEPS.split(", ", 5)])


def migration_steps(fingerprints: DataFrame) -> DataFrame:
    """One row for each file: its changes against the file before it in its stream, and ``rules``, the chained rename and cast rules (JSON: path in the file to path and type in the one table).

    Files are walked in order of file_no with only the last fingerprint in memory. The
    first file of a stream has no changes.
    """
    return fingerprints.repartition("stream_id").sortWithinPartitions("stream_id", "file_no").mapInPandas(_migrate_partition, _STEPS)


def schema_changes(raw: DataFrame) -> DataFrame:
    """Every change from a file to the next one of its stream: stream_id, file_no, change, old_path, new_path.

    change is added, removed, renamed (the values go on under another name in the same
    parent) or retyped. A field belongs to a file if one of its lines fills it. Order, nulls
    and the spelling of numbers are no changes; nor are repeated or late lines. Lines that
    are no JSON object are passed over. Empty tables give no rows.
    """
    steps = migration_steps(schema_fingerprints(raw))
    return steps.select("stream_id", "file_no", F.explode("changes").alias("c")).select("stream_id", "file_no", "c.change", "c.old_path", "c.new_path")


def _cast(value: object, kind: str) -> object:
    """A value as its contract's JSON type: wrapped values are unwrapped, number and text converted, one value and list of one exchanged."""
    if value is None:
        return None
    if isinstance(value, dict) and "v" in value and kind != "object":
        value = value["v"]
    if isinstance(value, list) and kind != "array":
        value = value[0] if len(value) == 1 else value
    if kind == "array" and isinstance(value, str):
        listed = _json(value)
        return listed if isinstance(listed, list) else [x for x in value.split(";") if x]
    if kind == "number" and isinstance(value, str):
        try:
            return float(value)
        except ValueError:
            return value
    if kind == "text" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return json.dumps(value)
    if kind == "object" and isinstance(value, str):
        return parse_object(value) or value
    return value


def _moved(value: object, at: str, rules: dict[str, list[str]]) -> object:
    """A value with the names and types of the one table, all the way down."""
    if isinstance(value, dict):
        out = {}
        for name, x in value.items():
            place, kind = rules.get(f"{at}.{name}", [name, None])
            out[re.split(r"\.", place)[-1]] = _moved(x if kind is None or x is None else _cast(x, kind), f"{at}.{name}", rules)
        return out
    if isinstance(value, list):
        return [_moved(x, at + "[]", rules) if isinstance(x, dict) else x for x in value]
    return value


def unify_records(raw: DataFrame, record_type: str) -> DataFrame:
    """All lines of one record type in one table, whatever the shape of their file.

    Columns: stream_id, file_no, line_no, the fields of the contract (numbers as double, objects
    and arrays as JSON text), ``extra`` (JSON of the fields that the contract does not have) and
    ``problem`` (null, ``unreadable`` for a line that is no JSON object, else the fields whose
    value could not be cast, which are then kept in ``extra``). Every line gives one row. Names
    and types inside objects are those the stream began with. A field that a file does not have
    gets the contract's default; one that only a line lacks is null.
    """
    contract = CONTRACT_FIELDS[record_type]
    model = {"observation": "Observation", "game_state": "GameState"}[record_type]
    defaults = {f.name: json.loads(f.default) for f in contracts()[model] if f.default not in (None, "null", "{}") and f.name in contract}
    lines = raw.where(F.col("record_type") == record_type)
    steps = migration_steps(schema_fingerprints(lines)).select("stream_id", "file_no", "rules")
    schema = "stream_id string, file_no bigint, line_no bigint, " + ", ".join(f"`{k}` {'double' if v == 'number' else 'string'}" for k, v in contract.items()) + ", extra string, problem string"

    def cell(name: str, value: object) -> object:
        return value if value is None or contract[name] in ("text", "number") else json.dumps(value, sort_keys=True)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            known: dict[str, dict] = {}
            rows = []
            for stream, file_no, line_no, payload, text in df[["stream_id", "file_no", "line_no", "payload", "rules"]].itertuples(index=False):
                if isinstance(text, str) and text not in known:
                    known[text] = json.loads(text)
                rules = known.get(text, {}) if isinstance(text, str) else {}
                there = {place for place, _ in rules.values()}
                record, extra, wrong = parse_object(payload), {}, []
                out = {k: cell(k, defaults[k]) if record is not None and k in defaults and k not in there else None for k in contract}
                for k, v in (record or {}).items():
                    name = rules.get(k, [k])[0]
                    value = _moved(_cast(v, contract[name]) if name in contract else v, k, rules)
                    if name not in contract or (value is not None and _kind(value) != contract[name]):
                        extra[name] = v
                        wrong += [name] if name in contract else []
                    else:
                        out[name] = cell(name, value)
                problem = "unreadable" if record is None else ",".join(sorted(wrong)) or None
                rows.append((stream, file_no, line_no, *out.values(), json.dumps(extra, sort_keys=True) if extra else None, problem))
            frame = pd.DataFrame(rows, columns=["stream_id", "file_no", "line_no", *contract, "extra", "problem"])
            yield frame.astype({k: "float64" for k, v in contract.items() if v == "number"} | {"file_no": "Int64", "line_no": "Int64"})

    return lines.select("stream_id", "file_no", "line_no", "payload").join(steps, ["stream_id", "file_no"], "left").mapInPandas(route, schema)

"""Parameter files: one decision a line, `for OPERATION` opening a section that overrides the general ones."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, replace

#: fixed values: the election keys, in their default order
ELECTION = ("grounds", "continuity", "agree", "heads", "cooccur", "walks", "shape", "confidence", "shared")


@dataclass(frozen=True)
class Firmware:
    k: float = 2.0
    lambda_: float = 0.05
    fan: int = 4096
    hops: int = 8
    emit: int = 32
    fact: float = 2.0
    enough: float = 0.0
    order: str = "witness"
    top: float | None = None
    rounds: int = 2
    breadth: int = 64
    nearest: int = 512
    walks: int = 64
    walkfan: int = 512
    steps: int = 4
    restart: float = 0.25
    sure: float = 2.0
    lift: float = 2.0
    tie: str = "first"
    seed: str = "observation"
    ooda: int = 0
    salience: float = 0.0
    multitier: bool = True
    combine: bool = True
    prevalence: bool = False
    shape: tuple[str, float] = ("frechet", 0.0)
    elect: tuple[str, ...] = ELECTION
    refuse_predicate: tuple[str, ...] = ()
    refuse_witness: tuple[str, ...] = ()
    only_predicate: tuple[str, ...] = ()
    negate: tuple[str, ...] = ()
    negate_relation: tuple[str, ...] = ()
    scope_stop: tuple[str, ...] = ()
    weigh: tuple[tuple[str, float], ...] = ()
    role_by: str | None = None
    role: tuple[tuple[str, float], ...] = ()
    take: tuple[tuple[str, ...], ...] = ()
    up: tuple[str, ...] = ()
    names: tuple[tuple[str, tuple[str, ...]], ...] = ()


_NUMBER = {"k": float, "lambda": float, "fan": int, "hops": int, "emit": int, "fact": float, "enough": float, "rounds": int, "breadth": int, "nearest": int, "walks": int, "walkfan": int, "steps": int, "restart": float, "sure": float, "lift": float, "ooda": int, "salience": float}
_CHOICE = {"order": ("witness", "standing"), "tie": ("first", "draw", "ask"), "seed": ("observation", "session")}
_WORDS = ("negate", "negate_relation", "scope_stop", "up")


@dataclass
class Sections:
    general: Firmware
    by_operation: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)

    def of(self, operation: str) -> Firmware:
        fw = self.general
        if operation == "search":
            fw = replace(fw, fan=512)
        for word, rest in self.by_operation.get(operation, []):
            fw = _apply(fw, word, rest)
        return fw


def _apply(fw: Firmware, word: str, rest: list[str]) -> Firmware:
    if word in _NUMBER:
        (v,) = rest
        return replace(fw, **{"lambda_" if word == "lambda" else word: _NUMBER[word](v)})
    if word in _CHOICE:
        (v,) = rest
        if v not in _CHOICE[word]:
            raise ValueError(f"{word} {v}")
        return replace(fw, **{word: v})
    if word == "top":
        return replace(fw, top=None if rest == ["always"] else float(rest[1]) if rest[0] == "within" else _bad(word))
    if word in ("multitier", "combine", "prevalence"):
        return replace(fw, **{word: {"on": True, "off": False}[rest[0]]})
    if word in ("refuse", "only"):
        kind, *names = rest
        key = f"{word}_{kind}"
        return replace(fw, **{key: (*getattr(fw, key), *names)})
    if word in _WORDS:
        return replace(fw, **{word: (*getattr(fw, word), *rest)})
    if word == "weigh":
        return replace(fw, weigh=(*fw.weigh, *((n, float(rest[0])) for n in rest[1:])))
    if word == "role":
        return replace(fw, role_by=rest[1]) if rest[0] == "by" else replace(fw, role=(*fw.role, *((n, float(rest[0])) for n in rest[1:])))
    if word == "shape":
        if rest[0] not in ("frechet", "outliers", "dtw", "edr"):
            _bad(word)
        return replace(fw, shape=(rest[0], float(rest[1]) if rest[1:] else 0.0))
    if word == "elect":
        if not {*rest} <= {*ELECTION}:
            _bad(word)
        return replace(fw, elect=tuple(rest))
    if word == "take":
        return replace(fw, take=(*fw.take, tuple(rest)))
    if word in ("lexicalization", "gloss", "usages", "equivalent"):
        return replace(fw, names=(*fw.names, (word, tuple(rest))))
    return _bad(word)


def _bad(word: str):
    raise ValueError(f"unknown or malformed decision: {word}")


def parse(text: str) -> Sections:
    out, section = Sections(Firmware()), None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        word, *rest = shlex.split(line)
        try:
            if word == "for":
                (section,) = rest
                out.by_operation.setdefault(section, [])
            elif section is None:
                out.general = _apply(out.general, word, rest)
            else:
                _apply(Firmware(), word, rest)
                out.by_operation[section].append((word, rest))
        except (ValueError, KeyError, IndexError) as e:
            raise ValueError(f"line {number}: {line!r}: {e}") from e
    return out

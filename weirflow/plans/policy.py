"""The policy language: one rule a line, read into plain records; what can't be read is disclosed, never skipped in silence."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..vocabulary import ALL_EFFECTS, EFFECTS, NET_CLASSES, REASON_CLASSES

ALLOWABLE = ["Net", "Llm", "Exec", "Fs", "Db"]
_BLANK = re.compile(r"[ \t\x0b\x0c]+")


@dataclass
class Deny:
    raw: str
    order: int
    effects: list[str]
    scope: str | None = None
    pure: bool = False
    unknown_classes: list[str] | None = None
    net_classes: list[str] | None = None


@dataclass
class Allow:
    raw: str
    order: int
    effect: str
    values: list[str]
    scope: str | None = None


@dataclass
class Forbid:
    raw: str
    order: int
    source: str
    target: str


@dataclass
class Only:
    raw: str
    order: int
    source: str
    targets: list[str]


@dataclass
class Accept:
    raw: str
    order: int
    fn: str
    effects: list[str]
    classes: list[str]
    rule: str
    because: str


@dataclass
class Policy:
    denies: list[Deny] = field(default_factory=list)
    allows: list[Allow] = field(default_factory=list)
    forbids: list[Forbid] = field(default_factory=list)
    onlys: list[Only] = field(default_factory=list)
    accepts: list[Accept] = field(default_factory=list)
    #: (line number, text, why): lines that do nothing, and lines that make the policy unusable.
    ignored: list[tuple[int, str, str]] = field(default_factory=list)
    fatal: list[tuple[int, str, str]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.denies or self.allows or self.forbids or self.onlys)


def rule_key(raw: str) -> str:
    return " ".join(raw.split())


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, rule) of lines with more than blanks and comments; a mark of byte order and any kind of line end are fine."""
    out = []
    for i, line in enumerate(re.split(r"\r\n|\n|\r", text.removeprefix("﻿")), 1):
        bare = _BLANK.sub(" ", line.split("#", 1)[0]).strip()
        if bare:
            out.append((i, bare))
    return out


def _effect(token: str, aliases: dict[str, list[str]]) -> tuple[str, list[str] | None]:
    """An effect token, perhaps narrowed to classes in brackets; raises ValueError if it isn't one."""
    m = re.fullmatch(r"([A-Za-z]+)(?:\[([^\]]*)\])?", token)
    if not m or m[1] not in ALL_EFFECTS:
        raise ValueError(f"{token} is no effect")
    if m[2] is None:
        return m[1], None
    known = {"Unknown": REASON_CLASSES, "Net": NET_CLASSES}.get(m[1])
    if known is None:
        raise ValueError(f"{m[1]} has no classes")
    out: list[str] = []
    for c in filter(None, (x.strip() for x in m[2].split(","))):
        if c in aliases and m[1] == "Unknown":
            out.extend(aliases[c])
        elif c in known:
            out.append(c)
        else:
            raise ValueError(f"{c} is no class of {m[1]}")
    if not out:
        raise ValueError(f"{token} names no class")
    return m[1], sorted(set(out))


def parse(text: str, aliases: dict[str, list[str]] | None = None) -> Policy:
    """All rules of a text.  Effects that can't be read are fatal: a rule that may not bite must not look as if it did."""
    out, aliases = Policy(), aliases or {}
    for i, line in lines_of(text):
        verb, _, rest = line.partition(" ")
        try:
            {"deny": _deny, "pure": _pure, "allow": _allow, "forbid": _forbid, "only": _only, "accept": _accept}[verb](out, i, line, rest, aliases)
        except KeyError:
            out.ignored.append((i, line, f"{verb} is no rule"))
        except ValueError as e:
            out.fatal.append((i, line, str(e)))
    return out


def _deny(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    # blanks inside brackets belong to the list of classes
    tokens = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", ""), rest).split()
    rule, scopes = Deny(line, i, []), []
    for t in tokens:
        if not scopes and (t.split("[")[0] in ALL_EFFECTS or "[" in t):
            effect, classes = _effect(t, aliases)
            rule.effects.append(effect)
            if classes and effect == "Unknown":
                rule.unknown_classes = classes
            elif classes:
                rule.net_classes = classes
        else:
            scopes.append(t)
    if not rule.effects:
        raise ValueError("no effect is denied")
    if len(scopes) > 1:
        raise ValueError("a rule has one scope")
    rule.scope = scopes[0] if scopes else None
    out.denies.append(rule)


def _pure(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    if len(rest.split()) > 1:
        raise ValueError("a rule has one scope")
    out.denies.append(Deny(line, i, list(EFFECTS), rest or None, pure=True))


def _allow(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    tokens = rest.split()
    if not tokens or tokens[0] not in ALLOWABLE:
        raise ValueError("only " + ", ".join(ALLOWABLE) + " have literals to allow")
    scope = None
    values = tokens[1:]
    if values[:1] == ["in"]:
        if len(values) < 2:
            raise ValueError("a scope is missing")
        scope, values = values[1], values[2:]
    if not values:
        raise ValueError("no literal is allowed")
    out.allows.append(Allow(line, i, tokens[0], values, scope))


def _arrow(rest: str) -> tuple[str, list[str]]:
    left, arrow, right = rest.partition("->")
    if not arrow or len(left.split()) != 1 or not right.split():
        raise ValueError("two scopes with -> between them are needed")
    return left.strip(), right.replace(",", " ").split()


def _forbid(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    source, targets = _arrow(rest)
    if len(targets) != 1:
        raise ValueError("one scope is forbidden a rule")
    out.forbids.append(Forbid(line, i, source, targets[0]))


def _only(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    out.onlys.append(Only(line, i, *_arrow(rest)))


def _accept(out: Policy, i: int, line: str, rest: str, aliases: dict) -> None:
    m = re.fullmatch(r"(\S+) (.+?) for (.+?) because (.+)", rest)
    if not m:
        raise ValueError("accept <unit> <effects> for <rule> because <reason>")
    effects, classes = [], []
    for t in m[2].split():
        effect, own = _effect(t, aliases)
        effects.append(effect)
        classes.extend(own or [])
        if effect == "Unknown" and not own:
            raise ValueError("an accepted Unknown lists its classes")
    out.accepts.append(Accept(line, i, m[1], sorted(set(effects)), sorted(set(classes)), rule_key(m[3]), m[4]))


def config(text: str) -> dict:
    """policy, baseline, deps, aliases, partners, engine of a configuration; an alias with an unknown class is refused whole."""
    out: dict = {"policy": None, "baseline": None, "deps": [], "aliases": {}, "partners": [], "engine": [], "refused": []}
    for i, line in lines_of(text):
        key, _, rest = line.partition(" ")
        if key in ("policy", "baseline"):
            out[key] = rest
        elif key == "deps":
            out["deps"] += [p for p in re.split(r"[ \t:,]+", rest) if p]
        elif key == "net-partner":
            out["partners"] += rest.split()
        elif key.lower() == "engine":  # judged by pin_state
            out["engine"].append(rest)
        elif key == "unknown-alias":
            name, _, classes = rest.partition("=")
            wanted = [c.strip() for c in classes.split(",") if c.strip()]
            if name.strip() and wanted and all(c in REASON_CLASSES for c in wanted):
                out["aliases"][name.strip()] = wanted
            else:
                out["refused"].append((i, line))
        else:
            out["refused"].append((i, line))
    return out


# fixed values: implementations that a pin may name
IMPLEMENTATIONS = ["java", "rust", "ts", "swift", "agents"]


def version(text: str) -> tuple[int | str, ...] | None:
    """The numbers of a version with two or three parts, the third being 0 if it is missing; None for all else."""
    m = re.fullmatch(r"[vV]?([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", text.strip())
    return (m[1], m[2], m[3] or "0") if m else None


def pin_state(text: str, implementation: str, running: str) -> str:
    """What a configuration's engine lines say of a running version: absent, match, mismatch, malformed or undetermined.

    A line names a version, for all or for one implementation, whose own line then decides.  Lines for others are theirs.
    A line that can't be read, or two that differ, make the pin malformed, since a guard must not be dropped in silence.
    Mismatch and malformed can't be evaluated (2); an absent pin and an unknown running version change nothing.
    """
    pins: dict[bool, set[str]] = {True: set(), False: set()}
    for _, line in lines_of(text):
        key, *rest = line.split()
        if key.lower() != "engine":
            continue
        named = bool(rest) and rest[0].lower() in IMPLEMENTATIONS
        if named and rest[0].lower() != implementation.lower():
            continue
        if len(rest) != 1 + named:
            return "malformed"
        pins[named].add(rest[-1])
    if any(len(found) > 1 for found in pins.values()) or any(version(v) is None for found in pins.values() for v in found):
        return "malformed"
    pin = next(iter(pins[True] or pins[False]), None)
    if pin is None:
        return "absent"
    if running.strip() in ("", "unknown"):
        return "undetermined"
    return "match" if version(pin) == version(running) else "mismatch"


def canonical(policy: Policy) -> list[str]:
    """The deny and pure rules in one spelling, sorted: what a scan ran under."""
    out = set()
    for d in policy.denies:
        effects = [e + (f"[{','.join(d.unknown_classes)}]" if e == "Unknown" and d.unknown_classes else f"[{','.join(d.net_classes)}]" if e == "Net" and d.net_classes else "") for e in sorted(set(d.effects))]
        out.add(" ".join(["pure" if d.pure else "deny " + " ".join(effects), *([d.scope] if d.scope else [])]))
    return sorted(out)


def upgrade(rule: Deny) -> str:
    """The rule that would also forbid what can't be resolved."""
    scope = f" {rule.scope}" if rule.scope else ""
    return f"deny Unknown{scope}" if rule.pure else f"deny {' '.join(rule.effects)} Unknown{scope}"


def document(policy: Policy) -> str:
    """The rules of a policy as JSON, in the file's order, and the lines that were dropped or can't be judged."""
    kinds = {"deny": policy.denies, "allow": policy.allows, "forbid": policy.forbids, "only": policy.onlys, "accept": policy.accepts}
    rules = [{"kind": kind, **{k: v for k, v in vars(r).items() if v not in (None, [], False)}} for kind, found in kinds.items() for r in found]
    out = {"rules": sorted(rules, key=lambda r: r["order"]), "ignored": [list(x) for x in policy.ignored], "refused": [list(x) for x in policy.fatal]}
    return json.dumps(out, indent=2, ensure_ascii=False)

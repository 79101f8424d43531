"""Row policies, column masks, users, roles and grants, kept in the store's manifest and in force for every statement.

A session with a principal reads tables through ``seen``: rows that a permissive policy lets through and all restrictive
ones, with masked columns, as one filter and projection that Catalyst pushes into the scan. Writes are checked against
WITH CHECK (or USING where a policy has none). The owner (no principal) and principals with ADMIN are under no rule. Grants
count once the store has users: a principal then needs SELECT, INSERT, UPDATE or DELETE on a table, its own or a role's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sql import quoted, register, rewrite, split_commas
from tessera.sources.store import ConstraintError, Store, StoreError


def catalog(store: Store) -> dict:
    return store.work.setdefault("security", {"enabled": [], "policies": [], "masks": [], "users": {}, "roles": {}})


def subjects(store: Store, principal: str) -> set[str]:
    """The principal, its roles and theirs, and public."""
    rules, found, todo = catalog(store), {"public"}, [principal]
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            entry = rules["users"].get(name) or rules["roles"].get(name) or {}
            todo += entry.get("roles", [])
    return found


def _granted(store: Store, principal: str, table: str | None) -> list[tuple[str, list[str] | None]]:
    """(privilege, columns) of the principal, for everything or for a table."""
    rules, out = catalog(store), []
    for name in subjects(store, principal):
        entry = rules["users"].get(name) or rules["roles"].get(name) or {}
        out += [(g["what"], g["columns"]) for g in entry.get("grants", []) if g["table"] in (None, table)]
    return out


def admin(store: Store, principal: str | None) -> bool:
    return principal is None or any(what == "admin" for what, _ in _granted(store, principal, None))


def require_admin(store: Store, principal: str | None) -> None:
    if not admin(store, principal):
        raise StoreError(f"{principal} may not do this")


def allow(store: Store, what: str, table: str, principal: str | None) -> None:
    if admin(store, principal) or not catalog(store)["users"]:
        return
    if not any(w in (what, "all") for w, _ in _granted(store, principal, table)):
        raise StoreError(f"{principal} has no {what} on {table}")


def _expr(store: Store, text: str, principal: str | None) -> Column:
    text = re.sub(r"'(?:[^']|'')*'|\b(?:current_user|session_user)\b(?:\s*\(\s*\))?", lambda m: m[0] if m[0][0] == "'" else quoted(principal or ""), text, flags=re.I)
    text = rewrite(text)
    register(store.spark, text)
    return F.expr(text)


def _test(store: Store, table: str, command: str, principal: str, check: bool) -> Column | None:
    """Whether a row may be read (or written); None where the table has no row security."""
    rules = catalog(store)
    if table not in rules["enabled"]:
        return None
    who = subjects(store, principal)
    own = [p for p in rules["policies"] if p["table"] == table and p["command"] in ("all", command) and (p["roles"] is None or who & set(p["roles"]))]
    said = lambda p: _expr(store, (p["check"] if check and p["check"] else p["using"]) or "true", principal)
    some = F.lit(False)
    for p in own:
        if p["kind"] == "permissive":
            some = some | said(p)
    for p in own:
        if p["kind"] == "restrictive":
            some = some & said(p)
    if any(p["kind"] == "restrictive" for p in own) and not any(p["kind"] == "permissive" and p["table"] == table for p in rules["policies"]):
        some = F.lit(True)
        for p in own:
            some = some & said(p)
    return F.coalesce(some, F.lit(False))


def seen(store: Store, table: str, principal: str | None, grants: bool = True) -> DataFrame:
    df = store.read(table)
    if admin(store, principal):
        return df
    rules = catalog(store)
    if grants and rules["users"]:
        own = [columns for what, columns in _granted(store, principal, table) if what in ("select", "all")]
        if not own:
            raise StoreError(f"{principal} has no select on {table}")
        if all(columns is not None for columns in own):
            df = df.select(*[c for c in df.columns if any(c in columns for columns in own)])
    if (test := _test(store, table, "select", principal, False)) is not None:
        df = df.filter(test)
    for mask in rules["masks"]:
        if mask["table"] == table and mask["column"] in df.columns and not subjects(store, principal) & set(mask["except"]):
            c = F.col(mask["column"])
            made = {"null": F.lit(None).cast(df.schema[mask["column"]].dataType), "redact": F.when(c.isNotNull(), F.lit(mask["text"])), "sha256": F.sha2(c.cast("string"), 256)}[mask["kind"]]
            df = df.withColumn(mask["column"], made)
    return df


def checked(store: Store, table: str, df: DataFrame, command: str, principal: str | None) -> DataFrame:
    """Rows to write; an error when they are written if one fails the policies' check."""
    if admin(store, principal) or (test := _test(store, table, command, principal, True)) is None:
        return df
    bad = df.filter(~test)
    if not bad.isEmpty():
        raise ConstraintError(f"a row breaks a policy of {table}")
    return df


def writable(store: Store, table: str, command: str, principal: str | None) -> Column | None:
    """The rows that UPDATE and DELETE may touch; None for all."""
    return None if admin(store, principal) else _test(store, table, command, principal, False)


def switch(store: Store, table: str, on: bool, principal: str | None) -> None:
    require_admin(store, principal)
    store.spec(table)
    rules = catalog(store)
    rules["enabled"] = sorted({*rules["enabled"], table} if on else {*rules["enabled"]} - {table})


def create_policy(store: Store, m: re.Match, principal: str | None) -> None:
    require_admin(store, principal)
    store.spec(m["table"])
    rules = catalog(store)
    if any((p["name"], p["table"]) == (m["name"], m["table"]) for p in rules["policies"]):
        raise StoreError(f"policy {m['name']!r} exists")
    roles = None if not m["roles"] else [r.strip() for r in m["roles"].split(",")]
    roles = None if roles and "public" in [r.lower() for r in roles] else roles
    rules["policies"].append({"name": m["name"], "table": m["table"], "command": (m["command"] or "all").lower(), "kind": (m["kind"] or "permissive").lower(), "roles": roles, "using": m["using"] or "true", "check": m["check"]})


def create_mask(store: Store, m: re.Match, principal: str | None) -> None:
    require_admin(store, principal)
    store.spec(m["table"]).column(m["column"])
    rules = catalog(store)
    if any((p["name"], p["table"]) == (m["name"], m["table"]) for p in rules["masks"]):
        raise StoreError(f"mask {m['name']!r} exists")
    exempt = [x.strip() for x in m["except"].split(",")] if m["except"] else []
    rules["masks"].append({"name": m["name"], "table": m["table"], "column": m["column"], "kind": m["kind"].lower(), "text": (m["text"] or "[REDACTED]").replace("''", "'"), "except": exempt})


def drop_rule(store: Store, m: re.Match, principal: str | None) -> None:
    require_admin(store, principal)
    home = {"policy": "policies", "mask": "masks"}[m["kind"].lower()]
    rules = catalog(store)
    kept = [p for p in rules[home] if p["name"] != m["name"] or (m["table"] and p["table"] != m["table"])]
    if len(kept) == len(rules[home]) and not m["maybe"]:
        raise StoreError(f"no {m['kind']} {m['name']!r}")
    rules[home] = kept


def principal(store: Store, m: re.Match, by: str | None) -> None:
    """CREATE and DROP of users and roles. Passwords are the platform's: none is stored."""
    require_admin(store, by)
    home = catalog(store)[f"{m['kind'].lower()}s"]
    if m["way"].lower() == "create":
        if m["name"] in home and not m["maybe"]:
            raise StoreError(f"{m['kind']} {m['name']!r} exists")
        home.setdefault(m["name"], {"roles": [], "grants": []})
    elif home.pop(m["name"], None) is None and not m["maybe"]:
        raise StoreError(f"no {m['kind']} {m['name']!r}")


def grant(store: Store, m: re.Match, by: str | None) -> None:
    """GRANT and REVOKE: privileges (SELECT (a, b), INSERT, UPDATE, DELETE, ALL, DDL, ADMIN) on a table, or a role."""
    require_admin(store, by)
    rules, give = catalog(store), m["way"].lower() == "grant"
    entry = rules["users"].get(m["who"]) or rules["roles"].get(m["who"])
    if entry is None:
        raise StoreError(f"no user or role {m['who']!r}")
    for part in split_commas(m["what"]):
        k = re.fullmatch(r"(?:role\s+)?(\w+)(?:\s+privileges)?\s*(?:\(([^)]*)\))?", part, re.I)
        if not k:
            raise StoreError(f"cannot grant {part!r}")
        name = k[1].lower()
        if name in ("select", "insert", "update", "delete", "all", "ddl", "admin"):
            columns = [c.strip() for c in k[2].split(",")] if k[2] else None
            one = {"what": name, "table": m["table"], "columns": columns}
            entry["grants"] = [g for g in entry["grants"] if (g["what"], g["table"]) != (name, m["table"])] + ([one] if give else [])
        elif k[1] in rules["roles"]:
            entry["roles"] = [r for r in entry["roles"] if r != k[1]] + ([k[1]] if give else [])
        else:
            raise StoreError(f"no role {k[1]!r}")

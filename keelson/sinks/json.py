"""The model as JSON: nested, or normalised into maps by id."""

from __future__ import annotations

import json

from ..model import Database, from_plain, to_plain


def export_json(db: Database, normalised: bool = False) -> str:
    return json.dumps(normalise(db) if normalised else to_plain(db), ensure_ascii=False, indent=2)


def import_json(text: str | dict) -> Database:
    """The inverse of export_json in its nested form."""
    return from_plain(Database, json.loads(text) if isinstance(text, str) else text)


def normalise(db: Database) -> dict[str, dict[int, dict]]:
    """One map for each kind of entity; children name their parents by id."""
    out: dict[str, dict[int, dict]] = {k: {} for k in ("tables", "fields", "indexes", "index_columns", "checks", "enums", "enum_values", "refs", "endpoints", "groups", "partials", "notes", "records", "project")}

    def add(entity: str, /, **row) -> int:
        key = len(out[entity]) + 1
        out[entity][key] = {"id": key, **row}
        return key

    field_ids, table_ids = {}, {}
    for t in db.tables:
        tid = table_ids[t.key] = add("tables", schema=t.key[0], name=t.name, alias=t.alias, note=t.note, color=t.color)
        for c in t.columns:
            plain = {k: v for k, v in to_plain(c).items() if k != "checks"}
            fid = field_ids[t.key, c.name] = add("fields", table_id=tid, **plain)
            for k in c.checks:
                add("checks", table_id=tid, field_id=fid, **to_plain(k))
        for i in t.indexes:
            iid = add("indexes", table_id=tid, **{k: v for k, v in to_plain(i).items() if k != "parts"})
            for p in i.parts:
                add("index_columns", index_id=iid, **to_plain(p))
        for k in t.checks:
            add("checks", table_id=tid, field_id=None, **to_plain(k))
    for e in db.enums:
        eid = add("enums", schema=e.schema, name=e.name, note=e.note)
        for v in e.values:
            add("enum_values", enum_id=eid, **to_plain(v))
    for r in db.all_refs():
        rid = add("refs", name=r.name, on_delete=r.on_delete, on_update=r.on_update, inactive=r.inactive)
        for e in r.ends:
            key = (e.schema or "public", e.table)
            add("endpoints", ref_id=rid, table_id=table_ids.get(key), field_ids=[field_ids.get((key, c)) for c in e.columns], relation=e.relation)
    for g in db.groups:
        add("groups", name=g.name, schema=g.schema, table_ids=[table_ids.get((s or "public", n)) for s, n in g.tables], note=g.note, color=g.color)
    for p in db.partials:
        add("partials", name=p.name, note=p.note, color=p.color)
    for n in db.notes:
        add("notes", **to_plain(n))
    for r in db.records:
        add("records", table_id=table_ids.get((r.schema or "public", r.table)), columns=r.columns, rows=to_plain(r.rows))
    if db.project:
        add("project", **to_plain(db.project))
    return out

"""Stored views that follow the changes of the tables that they are made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.store import Store, changed_chunks


def refresh_view(
    store: Store, view: str, source: str, build: Callable[[DataFrame], DataFrame], others: tuple[str, ...] = ()
) -> list[str]:
    """Bring a view up to date with a table of the same store; the chunks that were computed again.

    ``build`` makes the view's rows from those of some chunks of ``source`` and keeps the
    chunk column, so no group of the view reaches over chunks.  What the view was made
    from is published with it: only chunks whose folders differ since then are read and
    written, a chunk that has no rows any more goes, and a change of one of the ``others``
    that ``build`` reads (dimensions) computes all.  Distinct counts and removed rows are
    right, as a chunk is computed whole.
    """
    now = store.manifest()
    entry = now["tables"][source]
    note = f"view {view}"
    made = now["notes"].get(note)
    with store.transaction() as change:
        if change.base["version"] != now["version"]:
            raise RuntimeError("the store changed while the refresh began")
        beside = {t: now["tables"][t]["chunks"] for t in others}
        whole = made is None or made["others"] != beside or view not in now["tables"]
        chunks = sorted(entry["chunks"]) if whole else changed_chunks({"chunks": made["source"]}, entry)
        if whole:
            change.replace(view, build(store.read(source, now["version"])), entry["chunk"])
        elif chunks:
            change.replace_chunks(view, build(store.read(source, now["version"], chunks)), entry["chunk"], chunks)
        change.notes[note] = {"source": entry["chunks"], "others": beside}
    return chunks

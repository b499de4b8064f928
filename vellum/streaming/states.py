"""The document state machine as a stream: pages arrive in any number of batches, a document's state is kept between them, and
given up when nothing of it has come for a while."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

SCHEMA = "doc_id long, page long, state string, inherited boolean"


def _event(heading, numbered, density):
    h = (heading or "").strip().lower()
    if h in ("references", "bibliography"):
        return "references"
    if h.startswith(("appendix", "appendices")):
        return "appendix"
    if h in ("acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments"):
        return "acknowledgement"
    if numbered:
        return "normal_body"
    if density is not None and density >= 0.6:
        return "references"
    return None


def _advance(idle_ms: int | None, event_time: str | None):
    def advance(key, frames, state):
        """One document's pages of a batch, in page order, from the kept state."""
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else "normal_body"
        batch = pd.concat(list(frames)).sort_values("page", kind="stable")
        rows = []
        for r in batch.itertuples():
            event = _event(r.heading, r.numbered_section, r.reference_density)
            now = event or now
            rows.append((key[0], r.page, now, event is None))
        state.update((now,))
        if idle_ms is not None and event_time is None:
            state.setTimeoutDuration(idle_ms)
        elif idle_ms is not None:
            seen = int(batch[event_time].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=["doc_id", "page", "state", "inherited"])

    return advance


def document_state_stream(pages: DataFrame, idle_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """pages: a streaming DataFrame (doc_id, page, heading, numbered_section, reference_density). With ``idle_ms``, a document's state
    is removed when none of its pages came for so long: once the watermark on ``event_time``, a timestamp column, is so far
    past its last page, or, without one, by the clock of the query (which then runs batches without data too). A page that
    comes later begins anew, in the body. So the state holds the documents of the last while; without ``idle_ms`` it holds
    all there ever were, which is for streams that end."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout if event_time is None else GroupStateTimeout.EventTimeTimeout
    return pages.groupBy("doc_id").applyInPandasWithState(_advance(idle_ms, event_time), SCHEMA, "state string", "append", timeout)

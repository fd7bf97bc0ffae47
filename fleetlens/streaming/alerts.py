"""Alert records from applied changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetlens.operators.alerts import ALERT_KINDS, MARSHALERS, match_current_rules, to_alert
from fleetlens.sources.sinks import emit_alerts
from fleetlens.sources.tables import Batch


def alert_subscriber(
    path: str, base_url: str = "/", rules: Callable[[], tuple[DataFrame, dict[str, DataFrame], str]] | None = None
) -> Callable[[str, dict[str, DataFrame], DataFrame], None]:
    """Subscriber for :class:`~fleetlens.streaming.changes.ChangeApplier`: every written object of an alerting kind
    becomes a record, once, however often its batch is repeated. ``rules`` gives (rules, tables they query, rules
    version); it is read for each batch and again after the matching, see :func:`match_current_rules`."""
    def forward(kind: str, tables: dict[str, DataFrame], gone: DataFrame, batch: Batch) -> None:
        if kind not in [*ALERT_KINDS, *MARSHALERS] or kind not in tables:
            return
        alerts = to_alert(kind, tables[kind], base_url)
        if rules is not None:
            alerts = match_current_rules(alerts.sparkSession, alerts, rules)
        emit_alerts(alerts, path, Batch(batch.id, f"alerts-{kind}", batch.writer))
    return forward

import json
from datetime import datetime

from claimloom.sources import metrics


def test_requests_and_rows(spark):
    sent = []
    data = [{"timestamp": "2024-01-01T10:00:00Z", "value": v, "metric.topic": "t", "metric.partition": p} for p, v in (("0", 30.0), ("1", 10.0))]

    def send(body):
        sent.append(body)
        return json.dumps({"data": data})

    rows = metrics.metric_rows(spark, send, "received_bytes", metrics.BYTES_BY, "c1", datetime(2024, 1, 1, 10, 15, 47, 5))
    assert sorted(map(tuple, rows.collect())) == [(datetime(2024, 1, 1, 10), "t", "0", 30.0), (datetime(2024, 1, 1, 10), "t", "1", 10.0)]
    assert sent[0]["intervals"] == ["2024-01-01T10:00:00Z/2024-01-01T10:15:00Z"] and sent[0]["granularity"] == "PT1M"
    assert sent[0]["filter"]["filters"][0]["value"] == "c1" and sent[0]["group_by"] == ["metric.topic", "metric.partition"]
    assert metrics.partition_skew(rows).first().skew == 1.5
    assert metrics.metric_rows(spark, lambda body: "{}", "lag", metrics.LAG_BY, "c1", datetime(2024, 1, 1)).count() == 0

"""The same operators on unbounded input."""

from .bursts import ROCKSDB, stream_alert_steps
from .counts import live_counts
from .job import committed_alerts, committed_lines, start_alerts
from .layouts import PrefixLayout, start_entries
from .report import LiveReport
from .tail import TailSource, tail_logs

"""Asset scans, manifest snapshots and run logs."""

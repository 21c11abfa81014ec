"""Bits and table schemas of assets, edges, manifests and logs."""

from __future__ import annotations

#: The bits of an asset's flags.
PERMANENT, TEMPORARY, MODIFIED, FORCED, EXISTS = 1, 2, 4, 8, 16

#: The bits of a build reason.
REASON_FORCED, REASON_MISSING, REASON_CHANGED = 1, 2, 4

#: A change counts from this many seconds on.
TOLERANCE_SECONDS = 1

ASSET = "path string, ord long, size long, mtime timestamp, flags long, captures map<string,string>"
EDGE = "transition_id long, output string, dependency string, dep_ord long"
OUTPUT_STATE = "output string, ord long, mtime timestamp, flags long"
MANIFEST_DIR = "dir_id long, dir string"
MANIFEST_FILE = "dir_id long, file string, size long, last_modified timestamp, flags long"
RUN_LOG = "transition_id long, cmd_ord int, state string, exit_code int, started timestamp, ended timestamp, output string"

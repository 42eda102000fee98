"""Session logs of each host to the common frames.

An adapter gives requests (session, segment, label, model, day, counters), segments, and a measurement level.
"""

from . import claude, codex, copilot, cursor, gemini

ADAPTERS = {"claude": claude, "codex": codex, "gemini": gemini, "copilot": copilot, "cursor": cursor}

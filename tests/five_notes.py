"""Five literal notes with every pattern that the extractors know."""

#: Literal notes: (file, section, heading, line, content, date).
NOTES = [
    ("2026-01-13.md", "## Search", "Search", 3, "We moved [[Search Index]] to SQLite because of slow scans. See `ripgrep` and **fast path**. #performance", "2026-01-13"),
    ("2026-01-13.md", "## Deploy", "Deploy", 9, "Docker build for [[Search Index]] and [[Web Shell]] with `make -j` and `docker compose`; github.com/acme/shell", "2026-01-13"),
    ("2026-01-14.md", "## Notes", "Notes", 1, "The [[Web Shell]] outage resulted in a new @acme/retry package. Git and git bisect helped. `/etc/hosts` `127.0.0.1`", "2026-01-14"),
    ("2026-01-15.md", "## Review", "Review", 2, "[[Search Index]] again: TypeScript types, [[web shell]] and the [[Search Index]]. This meant less code. #review #performance", "2026-01-15"),
    ("2026-01-15.md", "## Plan", "Plan", 8, "No causes here; [[Web Shell]] and [[Search Index]] by `tsup`, **ab** and **Bold Plan** only.", "2026-01-15"),
]
_VALUES = ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in NOTES)
NOTES_SQL = f"notes AS (SELECT * FROM (VALUES {_VALUES}) v(file, section, heading, line, content, date))"

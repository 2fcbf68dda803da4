"""The same reading of documents in plain Python, for mappers that work on batches of records."""

from __future__ import annotations

import json

from .paths import segments


class LogView:
    """One parsed record. Scalars come out as str, int, float or bool."""

    def __init__(self, raw: str):
        self.raw, self.doc = raw, json.loads(raw)

    def _find(self, path: str):
        if isinstance(self.doc, dict) and path in self.doc:
            return True, self.doc[path]
        keys = segments(path) if "." in path or "[" in path else None
        if keys is None:
            return False, None
        at = self.doc
        for key in keys:
            if isinstance(key, int):
                if not isinstance(at, list) or key >= len(at):
                    return False, None
            elif not isinstance(at, dict) or key not in at:
                return False, None
            at = at[key]
        return True, at

    @staticmethod
    def _scalar(x):
        if isinstance(x, bool) or isinstance(x, (str, float)):
            return x
        if isinstance(x, int):
            return x if -(2**63) <= x < 2**63 else x - 2**64 if 0 < x < 2**64 else float(x)
        return None

    def has(self, path: str) -> bool:
        return self._find(path)[0]

    def get(self, path: str):
        return self._scalar(self._find(path)[1])

    def len(self, path: str) -> int | None:
        x = self._find(path)[1]
        return len(x) if isinstance(x, list) else len(x.encode()) if isinstance(x, str) else None

    def get_list(self, path: str) -> list | None:
        x = self._find(path)[1]
        return [self._scalar(e) for e in x if self._scalar(e) is not None] if isinstance(x, list) else None

    def get_map(self, path: str) -> dict | None:
        x = self._find(path)[1]
        return {k: self._scalar(e) for k, e in x.items() if self._scalar(e) is not None} if isinstance(x, dict) else None

    def keys(self, path: str) -> list[str]:
        x = self._find(path)[1]
        return sorted(x) if isinstance(x, dict) else []

    def log(self) -> str:
        return self.raw

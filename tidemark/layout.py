"""Where the layers live below one root."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    root: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def raw_stats(self) -> str:
        return self._at("bronze", "raw_statistics")

    @property
    def raw_csv(self) -> str:
        return self._at("bronze", "raw_csv")

    @property
    def raw_reference(self) -> str:
        return self._at("bronze", "raw_reference")

    @property
    def stats(self) -> str:
        return self._at("silver", "video_statistics_v2")

    @property
    def quarantine(self) -> str:
        return self._at("bronze", "quarantine")

    @property
    def history(self) -> str:
        return self._at("silver", "video_statistics")

    @property
    def reference(self) -> str:
        return self._at("silver", "reference_data")

    @property
    def gold_state(self) -> str:
        return self._at("gold_state")

    def gold(self, table: str) -> str:
        return self._at("gold", table)

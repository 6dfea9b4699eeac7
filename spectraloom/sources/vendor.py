"""Vendor formats that need the vendor's libraries: a source that says how to go on."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource


class VendorDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_spectra"

    def schema(self):
        raise self.error(self.options.get("path", ""))

    def reader(self, schema):
        raise self.error(self.options.get("path", ""))

    @staticmethod
    def error(path: str) -> NotImplementedError:
        return NotImplementedError(f"{path}: .raw and .d need the vendor's libraries; convert to mzML (centroided, with isolation windows) and read that")

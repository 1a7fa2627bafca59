"""Settings of a run, given as a JSON, TOML or YAML file or in code; secrets are arguments of the functions that need them."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from tallyloom.sources.schemas import OUTPUT_COLUMNS


@dataclass
class Settings:
    """prefix: what chat files' names begin with. exclude: how system messages begin. columns: output name -> field, None for blank."""

    prefix: str = ""
    exclude: list[str] = field(default_factory=list)
    columns: dict[str, str | None] = field(default_factory=lambda: dict(OUTPUT_COLUMNS))
    sheet: str = "주문내역"
    file: str = "orders_extracted.xlsx"

    @classmethod
    def load(cls, path: str) -> Settings:
        """The settings of a JSON file in this class's fields, or of a TOML or YAML file in sections: csv, output and output_columns.

        Other sections, such as those of secrets, are left alone. TOML has no null: a column without a field is an empty text there.
        """
        if path.endswith(".toml"):
            with open(path, "rb") as f:
                return cls.of_sections(tomllib.load(f))
        with open(path, encoding="utf-8") as f:
            if not path.endswith((".yaml", ".yml")):
                return cls(**json.load(f))
            try:
                import yaml
            except ImportError as e:
                raise ImportError(f"{path}: reading YAML needs the yaml module; JSON does not") from e
            return cls.of_sections(yaml.safe_load(f) or {})

    @classmethod
    def of_sections(cls, told: dict) -> Settings:
        csv, output = told.get("csv") or {}, told.get("output") or {}
        given = {"prefix": csv.get("filename_prefix"), "exclude": csv.get("exclude_messages"), "columns": told.get("output_columns"), "sheet": output.get("sheet_name"), "file": output.get("file_name")}
        if given["columns"] is not None:
            given["columns"] = {name: column or None for name, column in given["columns"].items()}
        return cls(**{k: v for k, v in given.items() if v is not None})

"""Scans: result documents, config text, file inventory."""

from .documents import (extract_path, flatten_sweep, list_results, parse_config_text, parse_documents,
                        read_param_configs, read_results, split_valid)
from .files import file_inventory, inventory_totals

__all__ = ["read_results", "list_results", "parse_documents", "split_valid", "extract_path", "flatten_sweep",
           "parse_config_text", "read_param_configs", "file_inventory", "inventory_totals"]

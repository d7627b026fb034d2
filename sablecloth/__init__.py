"""Sablecloth: privacy analytics on Spark.

Finds sensitive values in text columns, nested columns, JSON documents, URLs,
files and log streams, and masks, pseudonymises, removes or blocks them.

The names below are imported when they are first used, so that Python workers load
only the modules that they run.
"""

from importlib import import_module

_PUBLIC = {
    "errors": "BlockedError LimitError LineError NotCleanError PolicyError PrivacyError PseudonymError RuleError",
    "functions.masking": "Hashed Partial Placeholder Pseudonyms",
    "functions.rules": "CustomRule Rule",
    "functions.texts": "Finding",
    "operators.clean": "assert_clean clean clean_text explain findings findings_table reports result",
    "operators.documents": "Adapters SafeData audit_json audit_value clean_json safe_json to_safe_data",
    "operators.urls": "clean_url clean_url_column",
    "plans.compiler": "clean_frame",
    "plans.policy": "FieldRule PathRule Policy",
    "sources.files": "append_jsonl audit_text clean_file clean_jsonl iter_safe_jsonl safe_show scan_file scan_text scanned_jsonl",
    "streaming.logs": "SafeFilter SafeFormatter clean_logs clean_stream safe_logger",
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names.split()}

__all__ = sorted(_MODULE_OF)


def __getattr__(name: str) -> object:
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULE_OF[name]}"), name)


def __dir__() -> list[str]:
    return [*globals(), *__all__]

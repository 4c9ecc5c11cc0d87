"""Writers: the metric store with undoable loads, line formats, reports."""

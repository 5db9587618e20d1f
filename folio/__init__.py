"""Part of the folio engine."""

"""ledgerloom subpackage."""

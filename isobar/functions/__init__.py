"""isobar subpackage."""

"""Tables and pages in, tables out."""

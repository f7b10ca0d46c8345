"""The named reports: operators applied to tables, with the sort order of each."""

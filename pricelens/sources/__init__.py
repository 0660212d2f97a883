"""Reading stored pages, catalogs and snapshots, and writing snapshots and alerts."""

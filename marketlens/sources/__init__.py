"""Sources and sinks: test-table adapter, CSV ingest, staged layouts."""

from marketlens.sources.ingest import (create_database, import_csv, import_table,  # noqa: F401
                                       ingest_csv, load, load_csv, retype,
                                       with_zip, zip_dimension)
from marketlens.sources.layout import (LAYOUTS, bought_between, export_model,  # noqa: F401
                                       new_folder, read_months, stage_tables,
                                       write_clustered, write_months)

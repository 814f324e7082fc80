"""Python data sources for raster containers and portable anymaps."""

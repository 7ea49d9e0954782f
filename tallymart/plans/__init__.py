"""Jobs that read, transform and store: marts, warehouse load, result sets."""

"""Sources and sinks: FASTA, FASTQ and BED text to DataFrames, SAM records to text."""
